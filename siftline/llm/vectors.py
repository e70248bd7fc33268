"""Vectors from Arrow list columns, shared by the operators on embeddings."""
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(vector):
    """Spark's test that a vector is there and holds no null, infinite or undefined entry."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd


def with_vector(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector) as long and array<double>, rows with a null vector or a null or non-finite entry left out."""
    vector = F.col(vector_column).cast("array<double>")
    return rows.select(F.col(id_column).cast("long").alias("id"), vector.alias("vector")).filter(finite(F.col("vector")))


def usual_width(rows: DataFrame) -> int:
    """The commonest length of ``vector``, the larger of two; 0 for no rows.  Vectors of other lengths cannot be compared."""
    widths = rows.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"))
    first = widths.orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    return first[0]["width"] if first else 0


def matrix(column, width: int) -> np.ndarray:
    """An Arrow list column whose rows all have ``width`` entries, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)
