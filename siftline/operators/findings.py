"""Stored findings: listing, status changes, enrichment, storage and registries."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import text as T


def list_findings(findings: DataFrame, project_id=None, severity=None, status=None, skip=0, limit=100) -> DataFrame:
    """A page of findings by id; an empty or zero argument is no filter."""
    for column, value in (("project_id", project_id), ("severity", severity), ("status", status)):
        if value:
            findings = findings.filter(F.col(column) == value)
    return findings.orderBy("id").offset(skip).limit(limit)


def project_findings(findings: DataFrame, project_id, status=None, severity=None) -> DataFrame:
    """All findings of one project, newest first."""
    found = findings.filter(F.col("project_id") == project_id)
    if status:
        found = found.filter(F.col("status") == status)
    if severity:
        found = found.filter(F.col("severity") == severity)
    return found.orderBy(F.col("detected_at").desc(), "id")


def list_projects(projects: DataFrame, active_only=True, skip=0, limit=100) -> DataFrame:
    if active_only:
        projects = projects.filter("active")
    return projects.orderBy("id").offset(skip).limit(limit)


def confirmed_exemplars(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """Confirmed findings above 0.8 that serve as similarity exemplars; a limit keeps the first by id."""
    good = (F.col("status") == "confirmed") & (F.col("confidence_score") > 0.8)
    chosen = findings.filter(good)
    return chosen if limit is None else chosen.orderBy("id").limit(limit)


def enrich(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Add the rule's name, description, CWE and fix where the finding has a rule."""
    info = rules.select(
        (F.col("rule_ord") + 1).alias("pattern_id"),
        "name", "description", "cwe_id", F.col("fix").alias("fix_suggestion"),
    )
    return findings.join(info, "pattern_id", "left")


def apply_status_updates(findings: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """Apply the latest (detection_id, seq, status, reason) update of each finding."""
    latest = updates.groupBy("detection_id").agg(F.max_by(F.struct("status", "reason"), "seq").alias("u"))
    joined = findings.withColumnRenamed("status", "old_status").join(latest, "detection_id", "left")
    new = F.col("u.status")
    return joined.select(
        *[c for c in findings.columns if c != "status"],
        F.coalesce(new, F.col("old_status")).alias("status"),
        new.isNotNull().alias("verified_by_user"),
        F.coalesce(new == "false_positive", F.lit(False)).alias("suppressed"),
        F.when(new == "false_positive", F.col("u.reason")).alias("suppression_reason"),
        F.when(new == "fixed", as_of).alias("resolved_at"),
    )


def feedback_updates(feedback: DataFrame) -> DataFrame:
    """Feedback as status updates: confirmed, or false positive with the notes as reason."""
    return feedback.select(
        "detection_id", "seq",
        F.when(F.col("was_correct"), "confirmed").otherwise("false_positive").alias("status"),
        F.when(~F.col("was_correct"), F.concat(F.lit(fixed.FEEDBACK_REASON_PREFIX), "notes")).alias("reason"),
    )


def apply_feedback(feedback: DataFrame, findings: DataFrame, rules: DataFrame) -> DataFrame:
    """One outcome row per feedback; feedback on unknown findings fails."""
    info = rules.select((F.col("rule_ord") + 1).alias("pattern_id"), F.col("name"))
    known = findings.select("detection_id", "pattern_id", F.lit(True).alias("known"))
    joined = feedback.join(known, "detection_id", "left").join(info, "pattern_id", "left")
    return joined.select(
        "seq", "detection_id",
        F.coalesce("known", F.lit(False)).alias("success"),
        F.when(F.col("known"), F.coalesce("name", F.lit("Unknown"))).alias("vulnerability_type"),
        F.when(F.col("known"), F.when(F.col("was_correct"), "confirmed").otherwise("false_positive")).alias("status"),
        F.when(F.col("known").isNull(), "Detection not found").alias("error"),
    )


def validate_updates(updates: DataFrame) -> DataFrame:
    """Flag updates by status vocabulary, name length and language length."""
    status_ok = F.coalesce(F.col("status").isin(fixed.STATUSES), F.lit(False))
    name_ok = F.coalesce(F.length("name").between(1, 200), F.lit(False))
    language_ok = F.coalesce(F.length("language").between(1, 20), F.lit(False))
    checks = F.array_compact(F.array(
        F.when(~status_ok, F.lit("status")), F.when(~name_ok, F.lit("name")), F.when(~language_ok, F.lit("language"))
    ))
    return updates.withColumn("rejected_fields", F.array_join(checks, ",")).withColumn("accepted", F.size(checks) == 0)


def stored_form(findings: DataFrame) -> DataFrame:
    """Findings as they are stored, with an id that a re-run repeats."""
    key = F.md5(F.concat_ws("|", "file_path", F.col("line_start").cast("string"), "name"))
    return findings.select(
        F.concat(F.lit("DET-"), key).alias("detection_id"),
        "file_path", "line_start", "line_end", "severity",
        F.col("confidence").alias("confidence_score"),
        F.coalesce("code_snippet", F.lit("")).alias("code_snippet"),
        "ai_explanation",
    )


STORED_SCHEMA = """detection_id string, file_path string, line_start int, line_end int, severity string, confidence_score double,
code_snippet string, ai_explanation string, day date"""


def read_findings(spark, path: str) -> DataFrame:
    """The finding table, empty where nothing has been appended yet."""
    from ..sources.stored import folder_exists

    if not folder_exists(spark, path):
        return spark.createDataFrame([], STORED_SCHEMA)
    return spark.read.schema(STORED_SCHEMA).parquet(path)


def append_findings(findings: DataFrame, path: str, day: Column) -> None:
    """Append the findings that the table does not hold yet, one folder per day so that later look-backs prune.

    A finding's id is a digest of its place and name, so running a scan again adds nothing; of findings with one id the first by
    severity and text is kept.
    """
    new = stored_form(findings).withColumn("day", day.cast("date")).select(*[c.split()[0] for c in STORED_SCHEMA.split(",")])
    row = F.struct(*[c for c in new.columns if c != "detection_id"])
    new = new.groupBy("detection_id").agg(F.min(row).alias("row")).select("detection_id", "row.*")
    known = read_findings(findings.sparkSession, path).select("detection_id")
    new.join(known, "detection_id", "left_anti").write.mode("append").partitionBy("day").parquet(path)


def create_scans(requests: DataFrame, as_of: Column) -> DataFrame:
    """One new scan per (project_id, scan_type, seq) request: full by default, started now, nothing found yet.

    The id is a digest of the request, so that a request that is read again names the same scan.
    """
    kind = F.coalesce(F.col("scan_type"), F.lit("full"))
    key = F.md5(F.concat_ws("|", F.col("project_id").cast("string"), kind, F.col("seq").cast("string")))
    scans = requests.select(
        F.concat(F.lit("SCAN-"), key).alias("scan_id"), "project_id", kind.alias("scan_type"), as_of.alias("start_time"),
        F.lit(None).cast("timestamp_ntz").alias("end_time"), F.lit(0).alias("total_vulnerabilities"))
    return scans.distinct()


def upsert_projects(projects: DataFrame, updates: DataFrame, fields: list) -> DataFrame:
    """Get-or-create by name, then set only the fields an update carries, last one winning."""
    newest = updates.groupBy("name").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"new_{f}") for f in fields]
    )
    joined = projects.join(newest, "name", "full")
    return joined.select(
        "name", F.col("id").isNull().alias("created"),
        *[F.coalesce(f"new_{f}", f).alias(f) for f in fields],
    )


def project_stats(findings: DataFrame) -> DataFrame:
    """Open findings per project: total, per severity, mean confidence."""
    per = findings.filter(F.col("status") == "open").groupBy("project_id")
    return per.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in fixed.SEVERITY_ORDER[:4]],
        F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("average_confidence"),
    )


def close_scans(scans: DataFrame, findings: DataFrame, end_time: Column) -> DataFrame:
    """Duration in whole seconds and the project's open counts on every scan."""
    stats = project_stats(findings).drop("average_confidence")
    seconds = F.timestamp_diff("SECOND", F.col("start_time"), end_time)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ["total", *fixed.SEVERITY_ORDER[:4]]]
    # one row per project with open findings: broadcast is left to the size statistics
    return scans.join(stats, "project_id", "left").select("id", "project_id", seconds.alias("duration"), *counts)


def sorted_for_display(findings: DataFrame) -> DataFrame:
    from .scan import severity_rank

    ranked = findings.withColumn("rank", severity_rank(F.col("severity")))
    return ranked.orderBy("rank", "line_start", "id")

