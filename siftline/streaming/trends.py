"""Windowed counts and feedback totals, the same on tables and streams."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..operators.learning import adjustment_factor
from .live import LATENESS


EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _instant(column: str):
    """A naive UTC time as an instant, whatever the session's time zone."""
    return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {EPOCH}, {column}))")


def _windowed(findings: DataFrame, *window: str, lateness: str = LATENESS) -> DataFrame:
    """Counts per window; a stream needs instants for its watermark, a table keeps naive times."""
    start = F.col("w.start")
    timed = findings
    if findings.isStreaming:
        timed = findings.withColumn("detected_at", _instant("detected_at")).withWatermark("detected_at", lateness)
        start = F.expr(f"timestampadd(MICROSECOND, unix_micros(w.start), {EPOCH})")
    return timed.groupBy(F.window("detected_at", *window).alias("w")).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in fixed.SEVERITY_ORDER[:4]],
        F.avg("confidence_score").alias("average_confidence"),
    ).select(start.alias("window_start"), "total", *fixed.SEVERITY_ORDER[:4], "average_confidence")


def sliding_stats(findings: DataFrame, length: str = "24 hours", every: str = "6 hours", lateness: str = LATENESS) -> DataFrame:
    """Counts per sliding window; a stream drops findings later than ``lateness``."""
    return _windowed(findings, length, every, lateness=lateness)


def tumbling_trend(findings: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Counts per day; a stream drops findings later than ``lateness``."""
    return _windowed(findings, "1 day", lateness=lateness)


def feedback_totals(feedback: DataFrame) -> DataFrame:
    """Right and all feedback per type; on a stream this is the running state."""
    return feedback.groupBy("vulnerability_type").agg(
        F.count_if("was_correct").alias("correct"), F.count("*").alias("total"))


def adjustments_from_totals(totals: DataFrame, minimum: int = 5) -> DataFrame:
    """Every type's factor, 1 where fewer than ``minimum`` records back it (``enough`` is false)."""
    accuracy, enough = F.col("correct") / F.col("total"), F.col("total") >= minimum
    return totals.select("vulnerability_type", adjustment_factor(accuracy, enough).alias("adjustment"), "total", enough.alias("enough"))


def retrain_due(before: int, after: int, every: int = 50) -> bool:
    """Whether a multiple of ``every`` records was passed."""
    return after // every > before // every


def feedback_stream(feedback: DataFrame, path: str, checkpoint: str, on_retrain=None):
    """Start keeping the latest adjustments under ``path``; returns the running query.

    Each micro-batch writes a new version folder, so readers never see a half-written one.
    """
    def write(totals: DataFrame, epoch: int) -> None:
        spark = totals.sparkSession
        totals = totals.persist()  # one row per type
        total = totals.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()["n"]
        before = 0
        if epoch > 0:  # the total of the last version, which also holds after a restart
            before = spark.read.parquet(f"{path}/totals/version={epoch - 1}").first()["n"]
        adjustments_from_totals(totals).write.mode("overwrite").parquet(f"{path}/version={epoch}")
        spark.createDataFrame([(total,)], "n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/totals/version={epoch}")
        if on_retrain and retrain_due(before, total):
            on_retrain(total)
        totals.unpersist()

    return (
        feedback_totals(feedback).writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
