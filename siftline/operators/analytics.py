"""Aggregations over findings, scans and feedback.

Everything is a hash aggregation with map-side combining, so a severity, file or project
that holds a large share of the rows still arrives at its reducer as one row per task.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import language as L
from ..functions import text as T


def severity_distribution(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(
        F.count("*").alias("count"), F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("avg_confidence")
    )


def daily_trends(findings: DataFrame, as_of: Column, days: int = 30, project_id=None) -> DataFrame:
    """Per day: count of each severity and of all findings in the look-back window."""
    recent = findings.filter(F.col("detected_at") >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
    if project_id:
        recent = recent.filter(F.col("project_id") == project_id)
    return recent.groupBy(F.to_date("detected_at").alias("date")).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in fixed.SEVERITY_ORDER[:4]],
        F.count("*").alias("total"),
    )


def analyzer_of(finding_id: Column) -> Column:
    """Which analyzer made a finding, from its id; null when no mark is present."""
    return (
        F.when(F.contains(finding_id, F.lit("PATTERN")), "pattern_scanner")
        .when(T.contains_any(finding_id, ["PARSE", "AST"]), "ast_parser")
        .when(F.contains(finding_id, F.lit("AI-")), "ai_analyzer")
        .when(F.contains(finding_id, F.lit("GNN")), "gnn_analyzer")
        .when(F.contains(finding_id, F.lit("HYBRID")), "hybrid_analyzer")
    )


def analyzer_counts(findings: DataFrame, sample: int | None = None) -> DataFrame:
    """Findings per analyzer, of all rows or of the first ``sample`` by id."""
    counted = findings if sample is None else findings.orderBy("id").limit(sample)
    return counted.select(analyzer_of(F.col("detector_id")).alias("analyzer")).filter("analyzer IS NOT NULL").groupBy(
        "analyzer").agg(F.count("*").alias("detections"))


def language_share(findings: DataFrame) -> DataFrame:
    """Count and percent per display language among mapped files."""
    named = findings.select(L.display_name(F.col("file_path")).alias("language")).filter("language IS NOT NULL")
    counts = named.groupBy("language").agg(F.count("*").alias("count"))
    # at most one row per display name reaches the window
    share = F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy(F.lit(0)))
    return counts.select("language", "count", share.alias("percentage"))


def recent_stats(scans, findings, projects, rules, as_of: Column, as_of_scans: Column) -> DataFrame:
    """One row of 24-hour activity totals."""
    day = F.expr("INTERVAL 24 HOURS")
    of_scans = scans.filter(F.col("start_time") >= as_of_scans - day).agg(
        F.count("*").alias("scans_performed"),
        F.coalesce(F.sum("lines_scanned"), F.lit(0)).alias("lines_analyzed"),
        F.coalesce(F.sum("duration_seconds"), F.lit(0)).alias("seconds"),
    )
    of_findings = findings.filter(F.col("detected_at") >= as_of - day).agg(F.count("*").alias("vulnerabilities_found"))
    of_projects = projects.filter("active").agg(F.count("*").alias("active_projects"))
    of_rules = rules.agg(F.count("*").alias("patterns_in_database"))
    return of_scans.select(
        "scans_performed", of_findings.scalar().alias("vulnerabilities_found"), "lines_analyzed",
        F.coalesce(F.try_divide(F.col("lines_analyzed"), F.col("seconds")), F.lit(0.0)).alias("avg_scan_speed"),
        of_projects.scalar().alias("active_projects"), of_rules.scalar().alias("patterns_in_database"),
    )


CONFIDENCE_RANGES = [("0-20%", 0.2), ("20-40%", 0.4), ("40-60%", 0.6), ("60-80%", 0.8), ("80-100%", None)]


def confidence_histogram(findings: DataFrame) -> DataFrame:
    """Five fixed ranges, all present, with the overall mean and the share of the top range."""
    bucket = F.lit(len(CONFIDENCE_RANGES) - 1)
    for i in range(len(CONFIDENCE_RANGES) - 2, -1, -1):
        bucket = F.when(F.col("confidence_score") < CONFIDENCE_RANGES[i][1], i).otherwise(bucket)
    scored = findings.filter("confidence_score IS NOT NULL").select("confidence_score", bucket.alias("bucket"))
    totals = scored.agg(
        *[F.count_if(F.col("bucket") == i).alias(f"n{i}") for i in range(len(CONFIDENCE_RANGES))],
        F.count("*").alias("n"), F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("average_confidence"),
    )
    rows = F.array(*[F.struct(F.lit(name).alias("range"), F.col(f"n{i}").alias("count"))
                     for i, (name, _) in enumerate(CONFIDENCE_RANGES)])
    high = F.coalesce(F.try_divide(F.col("n4") * 100.0, F.col("n")), F.lit(0.0))
    return totals.select(F.inline(rows), "average_confidence", high.alias("high_confidence_percentage")).select(
        "range", "count", "average_confidence", "high_confidence_percentage")


def scan_summary(findings: DataFrame, key: str) -> DataFrame:
    """Per scan: total and the four named severities."""
    return findings.groupBy(key).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in fixed.SEVERITY_ORDER[:4]],
    )


def recent_scans(scans: DataFrame, per_project: int = 10) -> DataFrame:
    """The newest scans of every project; Spark limits each task's groups before the shuffle."""
    newest = Window.partitionBy("project_id").orderBy(F.col("start_time").desc(), F.col("id").desc())
    ranked = scans.withColumn("position", F.row_number().over(newest)).filter(F.col("position") <= per_project)
    return ranked.select(
        "project_id", "position", F.col("start_time").alias("date"),
        F.col("total_vulnerabilities").alias("total"), F.col("critical_count").alias("critical"),
    )


def top_files(findings: DataFrame, limit: int = 10) -> DataFrame:
    """Files with most findings, with mean confidence and risk = count * mean."""
    per = findings.groupBy("file_path").agg(
        F.count("*").alias("vulnerability_count"), F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("avg_confidence")
    )
    top = per.orderBy(F.col("vulnerability_count").desc(), "file_path").limit(limit)
    return top.select(
        "file_path", T.basename("file_path").alias("file_name"), "vulnerability_count", "avg_confidence",
        (F.col("vulnerability_count") * F.col("avg_confidence")).alias("risk_score"),
    )


def confidence_tiers(findings: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return findings.agg(
        F.count("*").alias("total"),
        F.count_if(c > 0.8).alias("high"),
        F.count_if((c > 0.5) & (c <= 0.8)).alias("medium"),
        F.count_if(c <= 0.5).alias("low"),
    )


def finding_counts(findings: DataFrame, kind: str) -> DataFrame:
    """Counts by severity and by kind in one pass over the data."""
    pairs = findings.groupBy("severity", kind).agg(F.count("*").alias("n"), F.sum("confidence_score").alias("s"))
    labelled = pairs.select(
        F.inline(F.array(
            F.struct(F.lit("severity").alias("grouping"), F.col("severity").alias("value"), "n", "s"),
            F.struct(F.lit("kind").alias("grouping"), F.col(kind).alias("value"), "n", "s"),
        ))
    )
    return labelled.groupBy("grouping", "value").agg(
        F.sum("n").alias("count"), (F.sum("s") / F.sum("n")).alias("mean_confidence"))


def project_rollup(results: DataFrame) -> DataFrame:
    """Per project over per-file scan results: files, findings, failures and workers."""
    return results.groupBy("project_id").agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("vulnerability_count").isNotNull()).alias("files_scanned"),
        F.count_if(F.col("vulnerability_count").isNull()).alias("failed"),
        F.coalesce(F.sum("vulnerability_count"), F.lit(0)).alias("total_vulnerabilities"),
        F.array_join(F.sort_array(F.collect_set("worker")), ",").alias("workers"),
    )


def message_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("type").agg(F.count("*").alias("count"))


def classifier_scores(results: DataFrame, keys: list) -> DataFrame:
    """Accuracy, precision, recall, F1, specificity and the confusion matrix."""
    label, predicted = F.col("label"), F.col("predicted")
    counts = results.groupBy(*keys).agg(
        F.count_if((label == 1) & (predicted == 1)).alias("true_positives"),
        F.count_if((label == 0) & (predicted == 1)).alias("false_positives"),
        F.count_if((label == 1) & (predicted == 0)).alias("false_negatives"),
        F.count_if((label == 0) & (predicted == 0)).alias("true_negatives"),
        F.avg("confidence").alias("avg_confidence"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives", "true_negatives"))

    def ratio(top, bottom):
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    return counts.select(
        *keys, "true_positives", "false_positives", "false_negatives", "true_negatives",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        ratio(tn, tn + fp).alias("specificity"),
        "avg_confidence",
    )
