"""Running a stream over the files at hand until they are used up."""
from pyspark.sql import DataFrame, SparkSession

from ..session import new_run_folder


#: Files one micro-batch takes at most, which bounds what a key brings at once.
FILES_PER_TRIGGER = 64


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """One table of the folder, a single file or a folder of part files, as a file stream."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a pattern that only this path matches: a stream takes a single file by pattern, not by name
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{name}.parque[t]")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Write what the stream yields to a table in the shared folder and read it back."""
    return drained(stream, name)[0]


def drained(stream: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The same, and how many rows came later than the watermark and were left out."""
    spark = stream.sparkSession
    out, checkpoint = new_run_folder(spark, name), new_run_folder(spark, name + "-state")
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    late = sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
    return spark.read.schema(stream.schema).parquet(out), late


def keep_epochs(stream: DataFrame, path: str, checkpoint: str, output_mode: str = "append"):
    """Start writing each micro-batch to a folder of its own, ``epoch=N``; returns the running query.

    A batch that is run again after a failure writes the same folder anew, so a record is kept once.
    """
    def write(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (
        stream.writeStream.outputMode(output_mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def kept_epochs(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of a folder of epochs, with the number of their ``epoch``."""
    return spark.read.option("basePath", path).schema(schema).parquet(f"{path}/epoch=*")
