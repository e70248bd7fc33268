"""Queries over stored findings, scans and projects."""
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from .. import views as V
from ..operators import analytics as A
from ..operators import findings as O
from ..sources.rules import rule_table, search_rules
from .registry import query, sql_values


RULES_CTE = sql_values(
    "rules", ["pattern_id", "rule_id", "name", "description", "severity", "cwe_id", "threshold", "fix"],
    [(i + 1, r["rule_id"], r["name"], r["description"], r["severity"], r["cwe_id"], r["threshold"], r["fix"])
     for i, r in enumerate(fixed.RULES)],
)
RULE_LANGUAGES_CTE = sql_values(
    "rule_languages", ["rule_id", "language"], [(r["rule_id"], l) for r in fixed.RULES for l in r["languages"]]
)


def r4(name):
    return F.round(F.col(name), 4).alias(name)


@query("severity_distribution", """
SELECT severity, count(*) AS count, round(avg(confidence_score), 4) AS avg_confidence
FROM v_detections GROUP BY severity""")
def severity_distribution(spark, folder):
    return A.severity_distribution(V.detections(spark, folder)).withColumn("avg_confidence", r4("avg_confidence"))


@query("project_stats", """
SELECT project_id, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'low') AS low, round(avg(confidence_score), 4) AS average_confidence
FROM v_detections WHERE status = 'open' GROUP BY project_id""")
def project_stats(spark, folder):
    return O.project_stats(V.detections(spark, folder)).withColumn("average_confidence", r4("average_confidence"))


@query("daily_trends", f"""
SELECT cast(detected_at AS date) AS date, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'low') AS low, count(*) AS total
FROM v_detections WHERE detected_at >= {V.AS_OF_SQL} - INTERVAL 30 DAY GROUP BY 1""")
def daily_trends(spark, folder):
    return A.daily_trends(V.detections(spark, folder), V.as_of())


@query("daily_trends_project", f"""
SELECT cast(detected_at AS date) AS date, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'low') AS low, count(*) AS total
FROM v_detections WHERE detected_at >= {V.AS_OF_SQL} - INTERVAL 7 DAY AND project_id = 3 GROUP BY 1""")
def daily_trends_project(spark, folder):
    return A.daily_trends(V.detections(spark, folder), V.as_of(), days=7, project_id=3)


@query("analyzer_counts", """
SELECT CASE WHEN contains(detector_id, 'PATTERN') THEN 'pattern_scanner'
  WHEN contains(detector_id, 'PARSE') OR contains(detector_id, 'AST') THEN 'ast_parser'
  WHEN contains(detector_id, 'AI-') THEN 'ai_analyzer' WHEN contains(detector_id, 'GNN') THEN 'gnn_analyzer'
  WHEN contains(detector_id, 'HYBRID') THEN 'hybrid_analyzer' END AS analyzer, count(*) AS detections
FROM v_detections GROUP BY 1 HAVING analyzer IS NOT NULL""")
def analyzer_counts(spark, folder):
    return A.analyzer_counts(V.detections(spark, folder))


@query("language_share", """
SELECT language, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS percentage FROM (
  SELECT CASE WHEN ends_with(file_path, '.py') THEN 'Python' WHEN ends_with(file_path, '.js') THEN 'JavaScript'
    WHEN ends_with(file_path, '.java') THEN 'Java' WHEN ends_with(file_path, '.php') THEN 'PHP'
    WHEN ends_with(file_path, '.c') OR ends_with(file_path, '.cpp') THEN 'C/C++' END AS language FROM v_detections)
WHERE language IS NOT NULL GROUP BY language""")
def language_share(spark, folder):
    return A.language_share(V.detections(spark, folder)).withColumn("percentage", r4("percentage"))


@query("realtime_stats", f"""
WITH s AS (SELECT count(*) AS n, cast(coalesce(sum(lines_scanned), 0) AS bigint) AS lines,
    cast(coalesce(sum(duration_seconds), 0) AS bigint) AS secs
  FROM v_scans WHERE start_time >= {V.AS_OF_SCANS_SQL} - INTERVAL 24 HOUR)
SELECT s.n AS scans_performed,
  (SELECT count(*) FROM v_detections WHERE detected_at >= {V.AS_OF_SQL} - INTERVAL 24 HOUR) AS vulnerabilities_found,
  s.lines AS lines_analyzed, CASE WHEN secs > 0 THEN round(lines / secs, 4) ELSE 0 END AS avg_scan_speed,
  (SELECT count(*) FROM v_projects WHERE active) AS active_projects, cast(8 AS bigint) AS patterns_in_database FROM s""")
def realtime_stats(spark, folder):
    stats = A.recent_stats(V.scans(spark, folder), V.detections(spark, folder), V.projects(spark, folder),
                           rule_table(spark), V.as_of(), V.as_of_scans())
    return stats.withColumn("avg_scan_speed", r4("avg_scan_speed"))


@query("confidence_histogram", """
WITH b AS (SELECT CASE WHEN confidence_score < 0.2 THEN '0-20%' WHEN confidence_score < 0.4 THEN '20-40%'
    WHEN confidence_score < 0.6 THEN '40-60%' WHEN confidence_score < 0.8 THEN '60-80%' ELSE '80-100%' END AS bucket,
    confidence_score FROM v_detections),
  t AS (SELECT count(*) AS n, avg(confidence_score) AS mean, count(*) FILTER (bucket = '80-100%') AS top FROM b),
  names(range) AS (VALUES ('0-20%'), ('20-40%'), ('40-60%'), ('60-80%'), ('80-100%'))
SELECT names.range, (SELECT count(*) FROM b WHERE b.bucket = names.range) AS count,
  round(t.mean, 4) AS average_confidence, round(t.top * 100.0::DOUBLE / t.n, 4) AS high_confidence_percentage
FROM names, t""")
def confidence_histogram(spark, folder):
    h = A.confidence_histogram(V.detections(spark, folder))
    return h.withColumns({c: r4(c) for c in ("average_confidence", "high_confidence_percentage")})


@query("scan_summary", """
SELECT scan_id, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'low') AS low FROM v_detections GROUP BY scan_id""")
def scan_summary(spark, folder):
    return A.scan_summary(V.detections(spark, folder), "scan_id")


@query("scan_completion", f"""
WITH st AS (SELECT project_id, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical,
    count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
    count(*) FILTER (severity = 'low') AS low FROM v_detections WHERE status = 'open' GROUP BY project_id)
SELECT v.id, v.project_id, cast(floor(epoch({V.AS_OF_SCANS_SQL}) - epoch(v.start_time)) AS bigint) AS duration,
  coalesce(total, 0) AS total, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high,
  coalesce(medium, 0) AS medium, coalesce(low, 0) AS low
FROM v_scans v LEFT JOIN st ON v.project_id = st.project_id""")
def scan_completion(spark, folder):
    return O.close_scans(V.scans(spark, folder), V.detections(spark, folder), V.as_of_scans())


@query("scan_trend", """
SELECT project_id, cast(position AS int) AS position, start_time AS date, total_vulnerabilities AS total,
  critical_count AS critical FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY start_time DESC, id DESC) AS position FROM v_scans)
WHERE position <= 10""")
def scan_trend(spark, folder):
    return A.recent_scans(V.scans(spark, folder))


@query("top_vulnerable_files", """
SELECT file_path, string_split(file_path, '/')[-1] AS file_name, count(*) AS vulnerability_count,
  round(avg(confidence_score), 4) AS avg_confidence, round(count(*) * avg(confidence_score), 4) AS risk_score
FROM v_detections GROUP BY file_path ORDER BY vulnerability_count DESC, file_path LIMIT 10""")
def top_vulnerable_files(spark, folder):
    return A.top_files(V.detections(spark, folder)).withColumns({c: r4(c) for c in ("avg_confidence", "risk_score")})


@query("findings_sorted", """
WITH r AS (SELECT id, severity, line_start,
  CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END AS rank
  FROM v_detections) SELECT id, severity, line_start, rank FROM r ORDER BY rank, line_start, id""")
def findings_sorted(spark, folder):
    return O.sorted_for_display(V.detections(spark, folder)).select("id", "severity", "line_start", "rank")


@query("confidence_tiers", """
SELECT count(*) AS total, count(*) FILTER (confidence_score > 0.8) AS high,
  count(*) FILTER (confidence_score > 0.5 AND confidence_score <= 0.8) AS medium,
  count(*) FILTER (confidence_score <= 0.5) AS low FROM v_detections""")
def confidence_tiers(spark, folder):
    return A.confidence_tiers(V.detections(spark, folder), "confidence_score")


@query("finding_counts", f"""
WITH {RULES_CTE}, d AS (SELECT v.severity, v.confidence_score, coalesce(rules.name, 'Unknown') AS kind
  FROM v_detections v LEFT JOIN rules ON v.pattern_id = rules.pattern_id)
SELECT 'severity' AS grouping, severity AS value, count(*) AS count, round(avg(confidence_score), 4) AS mean_confidence FROM d GROUP BY severity
UNION ALL SELECT 'kind', kind, count(*), round(avg(confidence_score), 4) FROM d GROUP BY kind""")
def finding_counts(spark, folder):
    named = O.enrich(V.detections(spark, folder), rule_table(spark)).withColumn("kind", F.coalesce("name", F.lit("Unknown")))
    return A.finding_counts(named, "kind").withColumn("mean_confidence", r4("mean_confidence"))


@query("project_findings", """
SELECT id, detection_id, file_path, status, severity, detected_at FROM v_detections
WHERE project_id = 3 AND status = 'open' AND severity = 'high'""")
def project_findings(spark, folder):
    found = O.project_findings(V.detections(spark, folder), 3, status="open", severity="high")
    return found.select("id", "detection_id", "file_path", "status", "severity", "detected_at")


@query("list_findings", """
SELECT id, detection_id, project_id, severity, status FROM v_detections
WHERE severity = 'high' ORDER BY id LIMIT 100 OFFSET 10""")
def list_findings(spark, folder):
    page = O.list_findings(V.detections(spark, folder), project_id=0, severity="high", skip=10)
    return page.select("id", "detection_id", "project_id", "severity", "status")


@query("list_projects", "SELECT id, name, main_language FROM v_projects WHERE active ORDER BY id LIMIT 100 OFFSET 5")
def list_projects(spark, folder):
    return O.list_projects(V.projects(spark, folder), skip=5).select("id", "name", "main_language")


@query("confirmed_exemplars", """
SELECT id, detection_id, severity, confidence_score FROM v_detections
WHERE status = 'confirmed' AND confidence_score > 0.8""")
def confirmed_exemplars(spark, folder):
    return O.confirmed_exemplars(V.detections(spark, folder)).select("id", "detection_id", "severity", "confidence_score")


@query("findings_enriched", f"""
WITH {RULES_CTE}
SELECT v.id, v.detection_id, v.severity, rules.name, rules.description, rules.cwe_id, rules.fix AS fix_suggestion
FROM v_detections v LEFT JOIN rules ON v.pattern_id = rules.pattern_id""")
def findings_enriched(spark, folder):
    rich = O.enrich(V.detections(spark, folder), rule_table(spark))
    return rich.select("id", "detection_id", "severity", "name", "description", "cwe_id", "fix_suggestion")


def _updates(spark, folder):
    """Two updates for the earlier half of the findings, none for the rest."""
    f = V.feedback(spark, folder)
    return f.select(
        F.concat(F.lit("DET-"), F.lpad(F.floor(F.col("seq") / 2).cast("string"), 8, "0")).alias("detection_id"), "seq",
        F.when(F.col("was_correct"), "confirmed").when(F.col("original_confidence") < 0.2, "fixed")
        .otherwise("false_positive").alias("status"),
        F.col("code_snippet").alias("reason"),
    )


@query("status_update", f"""
WITH u AS (SELECT concat('DET-', lpad(cast(seq // 2 AS string), 8, '0')) AS detection_id, seq, code_snippet AS reason,
    CASE WHEN was_correct THEN 'confirmed' WHEN original_confidence < 0.2 THEN 'fixed' ELSE 'false_positive' END AS status
  FROM v_feedback), l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY detection_id ORDER BY seq DESC) = 1)
SELECT v.id, v.detection_id, coalesce(l.status, v.status) AS status, l.status IS NOT NULL AS verified_by_user,
  coalesce(l.status = 'false_positive', false) AS suppressed,
  CASE WHEN l.status = 'false_positive' THEN l.reason END AS suppression_reason,
  CASE WHEN l.status = 'fixed' THEN {V.AS_OF_SQL} END AS resolved_at
FROM v_detections v LEFT JOIN l ON v.detection_id = l.detection_id""")
def status_update(spark, folder):
    done = O.apply_status_updates(V.detections(spark, folder), _updates(spark, folder), V.as_of())
    return done.select("id", "detection_id", "status", "verified_by_user", "suppressed", "suppression_reason", "resolved_at")


@query("feedback_status", f"""
SELECT v.id, CASE WHEN f.was_correct THEN 'confirmed' ELSE 'false_positive' END AS status, NOT f.was_correct AS suppressed,
  CASE WHEN NOT f.was_correct THEN concat('User feedback: ', f.code_snippet) END AS suppression_reason
FROM v_detections v JOIN v_feedback f ON v.detection_id = f.detection_id""")
def feedback_status(spark, folder):
    updates = O.feedback_updates(V.feedback(spark, folder).withColumn("notes", F.col("code_snippet")))
    done = O.apply_status_updates(V.detections(spark, folder), updates, V.as_of())
    return done.select("id", "status", "suppressed", "suppression_reason")


@query("feedback_apply", f"""
WITH {RULES_CTE}, f AS (SELECT seq, was_correct, concat('DET-', lpad(cast(seq * 2 AS string), 8, '0')) AS detection_id FROM v_feedback)
SELECT f.seq, f.detection_id, v.detection_id IS NOT NULL AS success,
  CASE WHEN v.detection_id IS NOT NULL THEN coalesce(rules.name, 'Unknown') END AS vulnerability_type,
  CASE WHEN v.detection_id IS NOT NULL THEN CASE WHEN was_correct THEN 'confirmed' ELSE 'false_positive' END END AS status,
  CASE WHEN v.detection_id IS NULL THEN 'Detection not found' END AS error
FROM f LEFT JOIN v_detections v ON f.detection_id = v.detection_id LEFT JOIN rules ON v.pattern_id = rules.pattern_id""")
def feedback_apply(spark, folder):
    f = V.feedback(spark, folder).withColumn(
        "detection_id", F.concat(F.lit("DET-"), F.lpad((F.col("seq") * 2).cast("string"), 8, "0")))
    return O.apply_feedback(f, V.detections(spark, folder), rule_table(spark))


@query("update_validation", """
WITH u AS (SELECT id, CASE WHEN pattern_id IS NULL THEN severity ELSE status END AS status,
    repeat(file_path, line_start // 10) AS name, concat(detector_id, detection_id) AS language FROM v_detections),
  c AS (SELECT id, status IN ('open','confirmed','false_positive','fixed') AS s, length(name) BETWEEN 1 AND 200 AS n,
    length(language) BETWEEN 1 AND 20 AS l FROM u)
SELECT id, s AND n AND l AS accepted, concat_ws(',', CASE WHEN NOT s THEN 'status' END, CASE WHEN NOT n THEN 'name' END,
  CASE WHEN NOT l THEN 'language' END) AS rejected_fields FROM c""")
def update_validation(spark, folder):
    d = V.detections(spark, folder)
    updates = d.select(
        "id", F.when(F.col("pattern_id").isNull(), F.col("severity")).otherwise(F.col("status")).alias("status"),
        F.repeat("file_path", F.floor(F.col("line_start") / 10).cast("int")).alias("name"),
        F.concat("detector_id", "detection_id").alias("language"),
    )
    return O.validate_updates(updates).select("id", "accepted", "rejected_fields")


@query("project_upsert", """
WITH u AS (SELECT concat('Customer#', lpad(cast(o_custkey + 500 AS string), 9, '0')) AS name, o_orderkey AS seq,
    CASE o_orderstatus WHEN 'F' THEN false WHEN 'O' THEN true END AS active,
    CASE WHEN starts_with(o_orderpriority, '1') THEN 'rust' END AS main_language FROM orders),
  n AS (SELECT name, arg_max(active, seq) FILTER (active IS NOT NULL) AS active,
    arg_max(main_language, seq) FILTER (main_language IS NOT NULL) AS main_language FROM u GROUP BY name)
SELECT coalesce(p.name, n.name) AS name, p.id IS NULL AS created, coalesce(n.active, p.active) AS active,
  coalesce(n.main_language, p.main_language) AS main_language FROM v_projects p FULL JOIN n ON p.name = n.name""")
def project_upsert(spark, folder):
    updates = V.table(spark, folder, "orders").select(
        F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") + 500).cast("string"), 9, "0")).alias("name"),
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "F", False).when(F.col("o_orderstatus") == "O", True).alias("active"),
        F.when(F.startswith("o_orderpriority", F.lit("1")), "rust").alias("main_language"),
    )
    return O.upsert_projects(V.projects(spark, folder), updates, ["active", "main_language"])


@query("rule_search", f"""
WITH {RULES_CTE}, {RULE_LANGUAGES_CTE}
SELECT p.id AS project_id, r.rule_id, r.severity FROM v_projects p JOIN rule_languages l ON p.main_language = l.language
JOIN rules r ON r.rule_id = l.rule_id WHERE r.severity = 'critical'""")
def rule_search(spark, folder):
    rules = search_rules(rule_table(spark), severity="critical")
    per_language = rules.select("rule_id", "severity", F.explode("languages").alias("main_language"))
    found = V.projects(spark, folder).join(F.broadcast(per_language), "main_language")
    return found.select(F.col("id").alias("project_id"), "rule_id", "severity")


@query("project_rollup", """
WITH f AS (SELECT project_id, file_path, count(*) AS n, min(status) AS status, min(detector_id) AS d FROM v_detections GROUP BY 1, 2),
  r AS (SELECT project_id, CASE WHEN status = 'open' THEN NULL ELSE n END AS vulnerability_count,
    concat('worker-', cast(length(file_path) % 4 AS string)) AS worker FROM f)
SELECT project_id, count(*) AS total_files, count(vulnerability_count) AS files_scanned,
  count(*) FILTER (vulnerability_count IS NULL) AS failed, cast(coalesce(sum(vulnerability_count), 0) AS bigint) AS total_vulnerabilities,
  string_agg(DISTINCT worker, ',' ORDER BY worker) AS workers FROM r GROUP BY project_id""")
def project_rollup(spark, folder):
    per_file = V.detections(spark, folder).groupBy("project_id", "file_path").agg(
        F.count("*").alias("n"), F.min("status").alias("status"))
    results = per_file.select(
        "project_id", F.when(F.col("status") != "open", F.col("n")).alias("vulnerability_count"),
        F.concat(F.lit("worker-"), (F.length("file_path") % 4).cast("string")).alias("worker"))
    return A.project_rollup(results)


@query("message_counts", "SELECT role AS type, count(*) AS count FROM conversations GROUP BY role")
def message_counts(spark, folder):
    return A.message_counts(V.table(spark, folder, "conversations").withColumnRenamed("role", "type"))


@query("lang_from_path", """
SELECT id, CASE WHEN ends_with(file_path, '.py') THEN 'python' WHEN ends_with(file_path, '.js') THEN 'javascript'
  WHEN ends_with(file_path, '.java') THEN 'java' WHEN ends_with(file_path, '.php') THEN 'php'
  WHEN ends_with(file_path, '.c') THEN 'c' WHEN ends_with(file_path, '.cpp') THEN 'cpp' ELSE 'unknown' END AS learned_as,
  CASE WHEN ends_with(file_path, '.py') THEN 'python' WHEN ends_with(file_path, '.js') THEN 'javascript'
  WHEN ends_with(file_path, '.java') THEN 'java' WHEN ends_with(file_path, '.php') THEN 'php'
  WHEN ends_with(file_path, '.c') THEN 'c' WHEN ends_with(file_path, '.cpp') THEN 'cpp' ELSE 'python' END AS embedded_as,
  CASE WHEN ends_with(file_path, '.py') THEN 'Python' WHEN ends_with(file_path, '.js') THEN 'JavaScript'
  WHEN ends_with(file_path, '.java') THEN 'Java' WHEN ends_with(file_path, '.php') THEN 'PHP'
  WHEN ends_with(file_path, '.c') OR ends_with(file_path, '.cpp') THEN 'C/C++' END AS shown_as FROM v_detections""")
def lang_from_path(spark, folder):
    from ..functions import language as L

    path = F.col("file_path")
    return V.detections(spark, folder).select(
        "id", L.from_suffix(path, "unknown").alias("learned_as"), L.from_suffix(path, "python").alias("embedded_as"),
        L.display_name(path).alias("shown_as"))


@query("severity_map", """
SELECT event_id, CASE WHEN lower(s) IN ('critical','high','medium','low','info') THEN lower(s) ELSE 'medium' END AS severity
FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'High' WHEN 'click' THEN 'blocker'
  ELSE 'low' END AS s FROM events)""")
def severity_map(spark, folder):
    from ..operators.scan import severity_name

    raw = F.when(F.col("event_type") == "error", "CRITICAL").when(F.col("event_type") == "purchase", "High").when(
        F.col("event_type") == "click", "blocker").otherwise("low")
    return V.table(spark, folder, "events").select("event_id", severity_name(raw).alias("severity"))
