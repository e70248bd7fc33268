"""Queries over live updates and windowed findings, on tables and as streams."""
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from .. import views as V
from ..session import new_run_folder
from ..streaming import live as Live
from ..streaming import runs as R
from ..streaming import trends as Tr
from .registry import query, sql_values
from .scan_queries import RULE_FINDINGS_CTE, RULE_HITS_CTE


def _messages(conversations):
    t = F.col("turn")
    full = F.to_json(F.struct(F.lit("code_update").alias("type"), F.col("text").alias("code"),
                              F.concat(F.lit("live/f"), F.col("conv_id").cast("string")).alias("file_path")))
    value = F.when(t % 4 == 3, F.col("text")).when(t % 4 == 2, '{"type": "ping"}').otherwise(full)
    return conversations.select("conv_id", "turn", value.alias("value"))


@query("stream_parse", """
SELECT conv_id, turn, turn % 4 <> 3 AS valid, CASE turn % 4 WHEN 3 THEN NULL WHEN 2 THEN 'ping' ELSE 'code_update' END AS type, CASE turn % 4 WHEN 3 THEN NULL WHEN 2 THEN '' ELSE text END AS code,
  CASE turn % 4 WHEN 3 THEN NULL WHEN 2 THEN 'untitled' ELSE concat('live/f', conv_id) END AS file_path, CASE WHEN turn % 4 <> 3 THEN 'python' END AS language,
  CASE WHEN turn % 4 = 3 THEN 'Invalid JSON format' END AS error FROM conversations""")
def stream_parse(spark, folder):
    return R.drain(Live.parse_messages(_messages(R.table_stream(spark, folder, "conversations"))), "messages")


@query("debounce_updates", """
SELECT client_id, file_path, seq FROM (SELECT *, lead(ts_ms) OVER (PARTITION BY client_id, file_path ORDER BY ts_ms, seq) AS nxt FROM v_code_updates) WHERE nxt IS NULL OR nxt - ts_ms >= 300""")
def debounce_updates(spark, folder):
    return Live.debounce(V.code_updates(spark, folder)).select("client_id", "file_path", "seq")


#: Milliseconds that a stream waits for late updates.
LATE_MS = 600_000


@query("debounce_stream", f"""
WITH d AS (SELECT *, lead(ts_ms) OVER (PARTITION BY client_id, file_path ORDER BY ts_ms, seq) AS nxt FROM v_code_updates)
SELECT client_id, file_path, seq, ts_ms FROM d WHERE (nxt IS NULL OR nxt - ts_ms >= 300) AND ts_ms + 300 <= (SELECT max(ts_ms) - {LATE_MS} FROM v_code_updates)""")
def debounce_stream(spark, folder):
    """The debounced updates of a stream that are final when it ends."""
    stream = Live.debounce_stream(V.code_updates_from(R.table_stream(spark, folder, "conversations")), lateness=f"{LATE_MS} milliseconds")
    return R.drain(stream, "debounce").select("client_id", "file_path", "seq", "ts_ms")


@query("version_changes", """
SELECT client_id, file_path, seq, prev IS NULL OR md5(prev) <> md5(code) AS changed FROM (SELECT *, lag(code) OVER (PARTITION BY client_id, file_path ORDER BY seq) AS prev FROM v_code_updates)""")
def version_changes(spark, folder):
    return Live.version_changes(V.code_updates(spark, folder)).select("client_id", "file_path", "seq", "changed")


@query("added_lines", """
WITH p AS (SELECT *, lag(code) OVER (PARTITION BY client_id, file_path ORDER BY seq) AS prev FROM v_code_updates),
l AS (SELECT client_id, file_path, seq, unnest(string_split(code, chr(10))) AS line, 1 AS d FROM p WHERE prev IS NOT NULL
  UNION ALL SELECT client_id, file_path, seq, unnest(string_split(prev, chr(10))), -1 FROM p WHERE prev IS NOT NULL)
SELECT client_id, file_path, seq, line, cast(sum(d) AS bigint) AS times FROM l GROUP BY 1, 2, 3, 4 HAVING sum(d) > 0""")
def added_lines(spark, folder):
    return Live.added_lines(Live.version_changes(V.code_updates(spark, folder)))


@query("changed_findings", """
SELECT id, file_path, line_start, line_end FROM v_detections v WHERE EXISTS (
  SELECT 1 FROM v_detections c WHERE c.severity = 'critical' AND c.file_path = v.file_path AND c.line_start BETWEEN v.line_start AND v.line_end)""")
def changed_findings(spark, folder):
    d = V.detections(spark, folder)
    changed = d.filter("severity = 'critical'").select("file_path", F.col("line_start").alias("line"))
    return Live.overlapping(d.select("id", "file_path", "line_start", "line_end"), changed, "id").select("id", "file_path", "line_start", "line_end")


@query("live_summary", f"""
WITH {RULE_FINDINGS_CTE}, d AS (SELECT DISTINCT file_path, line_start, name, severity FROM rule_findings)
SELECT f.file_path, count(d.name) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
  count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM v_code_files f LEFT JOIN d ON d.file_path = f.file_path GROUP BY 1""")
def live_summary(spark, folder):
    scanned = V.code_files(spark, folder).withColumn("findings", Live.rule_matches("content", "language"))
    return scanned.select("file_path", *Live.severity_summary(F.col("findings")))


def live_versions(files):
    """Four versions of each corpus file: as it is, longer, sent again unchanged, and with a risky line."""
    base = F.col("content")
    longer = F.concat(base, F.lit("\nvalue = 1"))
    risky = F.concat(F.lit("result = eval(text)\n"), longer)
    versions = files.select("file_id", "file_path", "language", F.posexplode(F.array(base, longer, longer, risky)).alias("v", "code"))
    return versions.select(
        F.concat(F.lit("client-"), (F.col("file_id") % 20).cast("string")).alias("client_id"), "file_path", "language",
        F.col("v").cast("long").alias("seq"), "code")


# the changes between the four versions are known: the whole text, the line added last, none, the line put first
LIVE_CTE = f"""WITH base AS (SELECT file_id, file_path, language, content, string_split(content, chr(10)) AS ls, unnest([0, 1, 2, 3])::BIGINT AS v FROM v_code_files),
live_files AS (SELECT file_id * 4 + v AS file_id, concat(file_path, '#', v) AS file_path, language,
  CASE v WHEN 0 THEN content WHEN 3 THEN concat('result = eval(text)', chr(10), content, chr(10), 'value = 1') ELSE concat(content, chr(10), 'value = 1') END AS content FROM base),
{RULE_HITS_CTE.replace('v_code_files', 'live_files')}, hit AS (SELECT DISTINCT file_path, line_no, rule_id FROM rule_hits WHERE confidence >= threshold),
blank AS (SELECT *, len(ls) AS n, len(list_filter(ls, lambda l: l = '')) AS empty_lines FROM base),
step AS (SELECT concat('client-', file_id % 20) AS client_id, file_path AS path, v, n, v = 2 AS cached, v = 3 OR (v = 1 AND content <> '') AS incremental,
  cast(CASE v WHEN 0 THEN CASE WHEN content = '' THEN 0 WHEN empty_lines > 0 AND (n < 200 OR empty_lines <= n // 100 + 1) THEN n - 1 ELSE n END WHEN 2 THEN 0 ELSE 1 END AS int) AS changed_lines,
  CASE WHEN v = 3 THEN 1 WHEN v = 1 AND content <> '' THEN n + 1 END AS only_line FROM blank)"""


def code_files_stream(spark, folder):
    """The corpus derived from a stream of the one table it comes from."""
    return V.code_files_from(R.table_stream(spark, folder, "part"))


def _flat(results):
    return results.select("client_id", "file_path", "seq", "incremental", "changed_lines", F.explode_outer("findings").alias("f")).select(
        "client_id", "file_path", "seq", "incremental", "changed_lines", F.col("f.line").alias("line"), F.col("f.rule_id").alias("rule_id"))


@query("stream_cache", f"""
{LIVE_CTE} SELECT client_id, path AS file_path, v AS seq, cached, incremental, changed_lines, count(hit.rule_id) AS shown
FROM step LEFT JOIN hit ON hit.file_path = concat(path, '#', CASE WHEN v = 2 THEN 1 ELSE v END) AND (only_line IS NULL OR hit.line_no = only_line) GROUP BY ALL""")
def stream_cache(spark, folder):
    """Per update: whether the cached result was used, and how many findings were shown."""
    results = R.drain(Live.live_scan(live_versions(code_files_stream(spark, folder)), expire=False), "live")
    return results.select("client_id", "file_path", "seq", "cached", "incremental", "changed_lines", F.size("findings").alias("shown"))


@query("incremental_findings", f"""
{LIVE_CTE} SELECT client_id, path AS file_path, v AS seq, incremental, changed_lines, hit.line_no AS line, hit.rule_id
FROM step LEFT JOIN hit ON hit.file_path = concat(path, '#', v) AND (only_line IS NULL OR hit.line_no = only_line) WHERE v <> 2""")
def incremental_findings(spark, folder):
    return _flat(Live.incremental_results(live_versions(V.code_files(spark, folder))))


RULE_TEXTS_CTE = sql_values("rule_text", ["rule_id", "severity", "name"], [(r["rule_id"], r["severity"], r["name"]) for r in fixed.RULES])


@query("live_records", f"""
{LIVE_CTE}, {RULE_TEXTS_CTE}, shown AS (SELECT step.*, hit.line_no, rule_text.* FROM step
  LEFT JOIN hit ON hit.file_path = concat(path, '#', CASE WHEN v = 2 THEN 1 ELSE v END) AND (only_line IS NULL OR hit.line_no = only_line)
  LEFT JOIN rule_text ON rule_text.rule_id = hit.rule_id)
SELECT client_id, path AS file_path, v AS seq, 'scan_completed' AS type, incremental, count(rule_id) AS total, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
  coalesce(string_agg(concat(line_no, ' ', name), chr(10) ORDER BY line_no, rule_id) FILTER (rule_id IS NOT NULL), '') AS vulnerabilities FROM shown GROUP BY ALL""")
def live_records(spark, folder):
    """Records of a stream of updates, kept by epoch and read back."""
    path, state = new_run_folder(spark, "records"), new_run_folder(spark, "records-state")
    records = Live.scan_records(Live.live_scan(live_versions(code_files_stream(spark, folder)), expire=False))
    R.keep_epochs(records, path, state).awaitTermination()
    kept = R.kept_epochs(spark, path, records.schema)
    lines = F.transform(F.array_sort("vulnerabilities", lambda a, b: F.when(a["line_start"] != b["line_start"], a["line_start"] - b["line_start"])
                                     .when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)),
                        lambda v: F.concat(v["line_start"].cast("string"), F.lit(" "), v["name"]))
    return kept.select("client_id", "file_path", "seq", "type", "incremental", "summary.*", F.array_join(lines, "\n").alias("vulnerabilities"))


@query("diff_lines", f"""
{LIVE_CTE} SELECT client_id, path AS file_path, v AS seq, CASE v WHEN 1 THEN cast(n + 1 AS varchar) WHEN 2 THEN '' ELSE '1' END AS changed_lines FROM step WHERE v > 0""")
def diff_lines(spark, folder):
    v = Live.version_changes(live_versions(V.code_files(spark, folder)).drop("language")).filter("previous_code IS NOT NULL")
    numbers = Live.diff_lines(F.col("previous_code"), F.col("code")).cast("array<string>")
    return v.select("client_id", "file_path", "seq", F.array_join(numbers, ",").alias("changed_lines"))


WINDOW_SQL = """count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
count(*) FILTER (severity = 'low') AS low, round(avg(confidence_score), 4) AS average_confidence"""


@query("sliding_stats", f"""
SELECT time_bucket(INTERVAL 6 HOUR, detected_at) - INTERVAL 6 HOUR * k AS window_start, {WINDOW_SQL} FROM v_detections, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY 1""")
def sliding_stats(spark, folder):
    return Tr.sliding_stats(V.detections(spark, folder)).withColumn("average_confidence", F.round("average_confidence", 4))


@query("tumbling_trend", f"SELECT date_trunc('day', detected_at) AS window_start, {WINDOW_SQL} FROM v_detections GROUP BY 1")
def tumbling_trend(spark, folder):
    return Tr.tumbling_trend(V.detections(spark, folder)).withColumn("average_confidence", F.round("average_confidence", 4))


FINAL_SQL = f"(SELECT max(detected_at) - INTERVAL {LATE_MS} MILLISECOND FROM v_detections)"


@query("sliding_stream", f"""
SELECT time_bucket(INTERVAL 6 HOUR, detected_at) - INTERVAL 6 HOUR * k AS window_start, {WINDOW_SQL} FROM v_detections, (SELECT unnest([0, 1, 2, 3]) AS k)
GROUP BY 1 HAVING window_start + INTERVAL 24 HOUR <= {FINAL_SQL}""")
def sliding_stream(spark, folder):
    """The sliding windows of a stream that are final when it ends."""
    stream = Tr.sliding_stats(V.detections_from(R.table_stream(spark, folder, "events")), lateness=f"{LATE_MS} milliseconds")
    return R.drain(stream, "sliding").withColumn("average_confidence", F.round("average_confidence", 4))


@query("tumbling_stream", f"""
SELECT date_trunc('day', detected_at) AS window_start, {WINDOW_SQL} FROM v_detections GROUP BY 1 HAVING window_start + INTERVAL 1 DAY <= {FINAL_SQL}""")
def tumbling_stream(spark, folder):
    """The days of a stream that are final when it ends."""
    stream = Tr.tumbling_trend(V.detections_from(R.table_stream(spark, folder, "events")), lateness=f"{LATE_MS} milliseconds")
    return R.drain(stream, "tumbling").withColumn("average_confidence", F.round("average_confidence", 4))


@query("stream_feedback", """
WITH a AS (SELECT vulnerability_type, count(*) AS total, count(*) FILTER (was_correct) / count(*) AS acc FROM v_feedback GROUP BY 1)
SELECT vulnerability_type, round(CASE WHEN total < 5 THEN 1 WHEN acc < 0.5 THEN acc + 0.5 ELSE (acc - 0.5) * 0.5 + 1 END, 4) AS adjustment, total, total >= 5 AS enough FROM a""")
def stream_feedback(spark, folder):
    path, state = new_run_folder(spark, "adjustments"), new_run_folder(spark, "adjustments-state")
    Tr.feedback_stream(V.feedback_from(R.table_stream(spark, folder, "events")), path, state).awaitTermination()
    versions = spark.read.option("basePath", path).parquet(f"{path}/version=*")
    # the versions are whole results; the last one holds, and its number comes from the folder names
    latest = versions.filter(F.col("version") == versions.agg(F.max("version")).scalar())
    return latest.select("vulnerability_type", F.round("adjustment", 4).alias("adjustment"), "total", "enough")
