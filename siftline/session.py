"""Session set-up and the shared folder used to cut lineage."""
import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(app="siftline", master=None, shuffle_partitions=None) -> SparkSession:
    """A session with adaptive execution on; cluster settings win over these defaults."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a local one only where none is set."""
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
    current = getattr(shared_folder, "_local", None)
    if current is None:
        current = tempfile.mkdtemp(prefix="siftline-checkpoint-")
        shared_folder._local = current
        atexit.register(shutil.rmtree, current, True)
    return current


def new_run_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a written table or a stream."""
    return os.path.join(shared_folder(spark), f"{name}-{os.urandom(8).hex()}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def unfolded(df: DataFrame) -> DataFrame:
    """Mark one side of a join whose rows came out of texts: lines, words, names, or one row per derived file.

    Spark's statistics know the small table that such rows come from, not the rows, and would send all of them through the
    driver to every task.  Marked, both sides are shuffled and sorted, and adaptive execution still splits a frequent key.
    """
    return df.hint("merge")


def spread(df: DataFrame, task_rows: int | None = None) -> DataFrame:
    """Give an input enough partitions for work that is heavy per row.

    A file of one row group is one task however costly its rows are.  An input that already
    has a partition per core, as any large one does, is left alone; where rows are short but much is
    made of each, ``task_rows`` bounds the rows of a partition as well.
    """
    if df.isStreaming:
        return df
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if task_rows:
        wanted = max(wanted, -(-df.count() // task_rows))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
