"""Joins whose rows come out of texts: Spark's statistics know only the small table below them."""
import pytest

from __spark_entry__ import queries


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["graph_edges", "graph_stats", "tfidf", "file_features"])
def test_rows_out_of_texts_are_not_broadcast(spark, folder, name):
    plan = planned(queries()[name](spark, folder))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_samples_are_not_broadcast(spark, folder):
    from siftline.plans.dataset_queries import pooled_samples

    plan = planned(pooled_samples(spark, folder))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
