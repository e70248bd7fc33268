"""Small fixed tables as literal expressions, so a lookup never needs a join."""
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def literal_lookup(key: Column, mapping: dict, default=None) -> Column:
    found = F.try_element_at(literal_map(mapping), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def _literal(value) -> Column:
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value])
    if isinstance(value, dict):
        return literal_map(value)
    return F.lit(value)


def literal_rows(spark: SparkSession, names: list, rows: list) -> DataFrame:
    """A DataFrame made of literals only; the row count is fixed by the program text."""
    structs = [F.struct(*[_literal(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    An expression named by a Python variable is copied wherever it is used, also into
    lambdas that run per element; a lambda variable is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
