"""Every query with a check must give the same rows as its SQL."""
import pytest

from siftline.checks import compare
from siftline.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.CHECK_SQL))
def test_query_matches_its_sql(spark, folder, name):
    same, _, message = compare(spark, folder, catalog.QUERIES[name], catalog.CHECK_SQL[name])
    assert same, message


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
