"""Helpers shared by the operators: stored tables, ranks, checked broadcasts, text buffers."""
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_run_folder

#: ``bytes.translate`` table that lower-cases A-Z and leaves every other byte alone.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


_kept = {}


def kept_by_worker(key, make):
    """The one object that a Python worker keeps between its tasks; that of another key goes first.

    Spark gives a worker to any stage, so what one operator remembers would else take memory beside the next one's.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget_kept():
    """For tasks that need the memory and keep nothing themselves."""
    _kept.clear()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only where a count proves at most ``rows`` rows; else leave the join to Spark.

    ``df`` should be a stored table: it is counted here.
    """
    return F.broadcast(df) if df.count() <= rows else df


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """Stored copy of ``df`` with its 0-based position by ``order``; only one row per partition meets in one task."""
    placed = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_at")), "ranked"
    )
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        placed.withColumn("_part", part).join(offsets, "_part")
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_at", "_before")
    )


def row_identity(df: DataFrame):
    """A number that stays with a row when the same table is read twice.

    Rows of files are named by file and place, which do not depend on how a scan is cut into tasks; other inputs,
    such as literal rows in tests, by their place in the plan.
    """
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return F.monotonically_increasing_id()
    return F.xxhash64("_metadata.file_path", "_metadata.row_index")


def text_bytes(column):
    """The values of an Arrow string column as bytes, null as empty."""
    import pyarrow as pa

    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


#: Hadoop's names of file systems that Arrow knows by another.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def file_system(uri: str):
    """(Arrow file system, path) of a Hadoop path; a path without a scheme is a local one."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    return fs.FileSystem.from_uri(ARROW_SCHEMES.get(scheme, scheme) + colon + rest)
