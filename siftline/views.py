"""Finding, feedback, corpus and score tables derived from the base tables.

Each view has a DataFrame form (narrow projections over one scan, no joins unless
stated) and a DuckDB text used by the checks.
"""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import spread

# the clock of every look-back: the day after the last event, and the end of the scan history
AS_OF_TEXT = "2024-01-31 00:00:00"
AS_OF_SCANS_TEXT = "2001-08-01 00:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF_TEXT}'"
AS_OF_SCANS_SQL = f"TIMESTAMP '{AS_OF_SCANS_TEXT}'"


def as_of():
    return F.lit(AS_OF_TEXT).cast("timestamp_ntz")


def as_of_scans():
    return F.lit(AS_OF_SCANS_TEXT).cast("timestamp_ntz")


# fixed values: corpus templates ('~' is a newline, '@N' the per-file number)
CODE_TEMPLATES = [
    ("python", ".py", 'import os~~def load@N(uid):~    # SELECT note~    sql = "SELECT a FROM t@N WHERE id = " + uid~    return db.execute(sql)~~def run@N(cmd):~    os.system(f"echo {cmd}")~    return eval(cmd)'),
    ("python", ".py", 'import pickle, subprocess~def unpack(blob):~    item = pickle.loads(blob)~    exec(item.code)~    cursor.execute(query)~    subprocess.call(line, shell=True)~    return item'),
    ("javascript", ".js", "function show@N(msg) {~  // innerHTML note~  box.innerHTML = msg;~  document.write(msg);~  setTimeout(msg, @N);~  return eval(msg);~}"),
    ("java", ".java", "public class Job@N {~  private Object read(InputStream in) {~    ObjectInputStream ois = new ObjectInputStream(in);~    Runtime.getRuntime().exec(cmd);~    return ois.readObject();~  }~}"),
    ("php", ".php", '<?php~# system note~echo "hi " . $_GET["n"];~$o = unserialize($_POST["o"]);~system($cmd);~exec($cmd);'),
    ("c", ".c", '#include <stdio.h>~int main(int argc) {~  char buf[@N];~  char *p = malloc(@N);~  gets(buf);~  strcpy(p, buf);~  printf("%s", p);~  if (argc > 1) system(buf);~  free(p);~  return 0;~}'),
    ("cpp", ".cpp", 'using namespace std;~int total = 0;~for (int i = 0; i < @N; i++) {~  total = total + i;~}~sprintf(out, "%d", total);'),
    ("python", ".py", 'def safe@N(uid):~    sql = "SELECT a FROM t WHERE id = ?"~~    return db.run(sql, (uid,))~~stray = 1'),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(index, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def detections_from(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    kind = _pick(e % 7, ["PATTERN", "PARSE", "AST", "AI-X", "GNN", "HYBRID", "OTHER"])
    suffix = _pick(e % 8, [".py", ".js", ".java", ".php", ".c", ".cpp", ".py", ".rb"])
    severity = (
        F.when(F.col("event_type") == "error", "critical")
        .when(F.col("event_type") == "purchase", "high")
        .when(F.col("event_type") == "click", "medium")
        .when(F.col("event_type") == "view", "low")
        .otherwise("info")
    )
    return events.select(
        e.alias("id"),
        F.concat(F.lit("DET-"), F.lpad(e.cast("string"), 8, "0")).alias("detection_id"),
        F.concat(kind, F.lit("-"), e.cast("string")).alias("detector_id"),
        F.concat(F.lit("src/mod"), (F.col("user_id") % 40).cast("string"), suffix).alias("file_path"),
        (e % 200 + 1).cast("int").alias("line_start"),
        (e % 200 + 1 + e % 3).cast("int").alias("line_end"),
        severity.alias("severity"),
        F.least(F.col("value") / F.lit(100.0), F.lit(1.0)).alias("confidence_score"),
        _pick(e % 4, ["open", "confirmed", "false_positive", "fixed"]).alias("status"),
        F.when(e % 5 != 0, (e % 9).cast("int")).alias("pattern_id"),
        (F.col("user_id") % 10).cast("int").alias("project_id"),
        (e % 300).cast("int").alias("scan_id"),
        F.col("ts").alias("detected_at"),
    )


def detections(spark, folder) -> DataFrame:
    return detections_from(table(spark, folder, "events"))


def projects(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("int").alias("id"),
        F.col("c_name").alias("name"),
        (F.col("c_acctbal") > 0).alias("active"),
        _pick(F.col("c_custkey") % 3, ["python", "java", "c"]).alias("main_language"),
    )


def scans(spark, folder) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        k.alias("id"),
        (F.col("o_custkey") % 10).cast("int").alias("project_id"),
        F.col("o_orderdate").alias("start_time"),
        F.floor("o_totalprice").cast("int").alias("lines_scanned"),
        (k % 50).cast("int").alias("duration_seconds"),
        (k % 17).cast("int").alias("total_vulnerabilities"),
        (k % 5).cast("int").alias("critical_count"),
    )


def feedback_from(events: DataFrame) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    kind = F.col("event_type")
    vulnerability = (
        F.when(kind == "error", "SQL Injection")
        .when(kind == "purchase", "Command Injection")
        .when(kind == "click", "XSS")
        .when(kind == "view", "Path Traversal")
        .otherwise("Insecure Deserialization")
    )
    cut = F.when(kind == "error", 9).when(kind == "purchase", 7).when(kind == "click", 5).when(kind == "view", 3).otherwise(8)
    nine = (u % 9).cast("string")
    snippet = (
        F.when(e % 6 == 0, F.concat(F.lit('sql = "SELECT c'), nine, F.lit(' FROM t" + uid')))
        .when(e % 6 == 1, F.concat(F.lit('os.system("ls " + path'), nine, F.lit(")")))
        .when(e % 6 == 2, "node.innerHTML = request.body")
        .when(e % 6 == 3, F.concat(F.lit("data = open(base + name"), nine, F.lit(").read()")))
        .when(e % 6 == 4, "obj = pickle.loads(payload)  # check later")
        .otherwise("value = sanitize(user_input)")
    )
    method = F.when(e % 2500 == 0, "gnn").when(u % 3 == 0, "pattern").when(u % 3 == 1, "ast").otherwise("hybrid")
    return events.select(
        F.concat(F.lit("DET-"), F.lpad(e.cast("string"), 8, "0")).alias("detection_id"),
        e.alias("seq"),
        vulnerability.alias("vulnerability_type"),
        ((e * 7 + u) % 10 < cut).alias("was_correct"),
        F.least(F.col("value") / F.lit(100.0), F.lit(1.0)).alias("original_confidence"),
        method.alias("detection_method"),
        snippet.alias("code_snippet"),
        F.col("ts").alias("feedback_ts"),
    )


def feedback(spark, folder) -> DataFrame:
    return feedback_from(table(spark, folder, "events"))


def code_files_from(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    slot = k % len(CODE_TEMPLATES)
    prefix = F.when(k % 11 == 0, "tests/test_f").otherwise("app/f")
    body = _pick(slot, [body.replace("~", "\n") for _, _, body in CODE_TEMPLATES])
    return part.select(
        k.alias("file_id"),
        _pick(slot, [lang for lang, _, _ in CODE_TEMPLATES]).alias("language"),
        F.concat(prefix, k.cast("string"), _pick(slot, [ext for _, ext, _ in CODE_TEMPLATES])).alias("file_path"),
        F.replace(body, F.lit("@N"), F.col("p_size").cast("string")).alias("content"),
    )


#: Files one task makes and works on at most; their rows come from a few bytes each.
TASK_FILES = 1 << 16


def code_files(spark, folder) -> DataFrame:
    return code_files_from(spread(table(spark, folder, "part").select("p_partkey", "p_size"), TASK_FILES))


def documents(spark, folder) -> DataFrame:
    return spread(table(spark, folder, "documents"))


def code_updates_from(conversations: DataFrame) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    sends = F.when(t % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select("*", F.explode(sends).alias("resend")).select(
        F.concat(F.lit("client-"), (c % 20).cast("string")).alias("client_id"),
        F.concat(F.lit("live/f"), c.cast("string"), F.lit(".py")).alias("file_path"),
        (t * 2 + F.col("resend")).alias("seq"),
        (c * 60000 + t * 250 + F.col("resend") * 100).alias("ts_ms"),
        F.col("text").alias("code"),
    )


def code_updates(spark, folder) -> DataFrame:
    return code_updates_from(table(spark, folder, "conversations"))


def pattern_vectors(spark, folder) -> DataFrame:
    """Known vectors (three of ten), mutations (one of ten) and queries (the rest), all growing with the table."""
    e = table(spark, folder, "embeddings")
    k = e.filter(F.col("vec_id") % 10 < 3).select(F.col("vec_id").alias("k_id"), F.col("embedding").alias("k_embedding"))
    v = F.col("vec_id")
    keep = (F.lit(64) - v % 40).cast("int")
    spliced = F.concat(
        F.slice("k_embedding", F.lit(1), keep),
        F.slice("embedding", keep + 1, (v % 40).cast("int")),
    )
    return e.join(k, v - v % 10 + v % 3 == F.col("k_id")).select(
        F.concat(F.lit("P-"), v.cast("string")).alias("pattern_id"),
        F.col("label").alias("type_id"),
        F.when(v % 10 < 3, "known").when(v % 10 == 3, "mutation").otherwise("query").alias("part_role"),
        F.when(v % 10 < 3, F.col("embedding")).otherwise(spliced).alias("embedding"),
    )


def labelled(spark, folder) -> DataFrame:
    d = table(spark, folder, "documents").alias("d")
    l = table(spark, folder, "labels").alias("l")
    cwe = _pick(F.col("d.doc_id") % 6, ["89", "79", "78", "22", "190", "999"])
    flipped = (F.col("toxic") == 1) | (F.col("d.doc_id") % 9 == 0)
    return d.join(l, F.col("d.doc_id") == F.col("l.doc_id")).select(
        F.col("d.doc_id").alias("file_id"),
        F.col("lang").alias("language"),
        F.concat(F.lit("CWE-"), cwe).alias("cwe_id"),
        F.col("text").alias("code"),
        F.col("quality").alias("label"),
        F.when(flipped, 1 - F.col("quality")).otherwise(F.col("quality")).alias("predicted"),
        ((F.col("n_chars") % 100).cast("double") / F.lit(100.0)).alias("confidence"),
    )


def model_scores(spark, folder) -> DataFrame:
    k = F.col("file_id")
    kinds = ["SQL Injection", "XSS", "Command Injection", "Path Traversal", "Insecure Deserialization"]

    def hundredth(factor, modulus):
        return (k * factor % modulus).cast("double") / F.lit(100.0)

    return code_files(spark, folder).select(
        "file_id", "file_path", "language",
        _pick(k % 5, kinds).alias("vulnerability_type"),
        hundredth(37, 100).alias("score"),
        hundredth(53, 100).alias("type_confidence"),
        hundredth(71, 40).alias("graph_density"),
    )


def _template_sql() -> str:
    rows = []
    for slot, (language, ext, body) in enumerate(CODE_TEMPLATES):
        quoted = body.replace("'", "''")
        rows.append(f"SELECT {slot} AS k, '{language}' AS language, '{ext}' AS ext, '{quoted}' AS body")
    return " UNION ALL ".join(rows)


VIEW_SQL = {
    "v_detections": """
SELECT event_id AS id,
  concat('DET-', lpad(cast(event_id AS string), 8, '0')) AS detection_id,
  concat(CASE cast(event_id % 7 AS int) WHEN 0 THEN 'PATTERN' WHEN 1 THEN 'PARSE'
         WHEN 2 THEN 'AST' WHEN 3 THEN 'AI-X' WHEN 4 THEN 'GNN' WHEN 5 THEN 'HYBRID' ELSE 'OTHER' END,
         '-', cast(event_id AS string)) AS detector_id,
  concat('src/mod', cast(user_id % 40 AS string),
         CASE cast(event_id % 8 AS int) WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.java' WHEN 3 THEN '.php'
         WHEN 4 THEN '.c' WHEN 5 THEN '.cpp' WHEN 6 THEN '.py' ELSE '.rb' END) AS file_path,
  cast(event_id % 200 + 1 AS int) AS line_start,
  cast(event_id % 200 + 1 + event_id % 3 AS int) AS line_end,
  CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium'
       WHEN 'view' THEN 'low' ELSE 'info' END AS severity,
  least(value / cast(100 AS double), cast(1 AS double)) AS confidence_score,
  CASE cast(event_id % 4 AS int) WHEN 0 THEN 'open' WHEN 1 THEN 'confirmed'
       WHEN 2 THEN 'false_positive' ELSE 'fixed' END AS status,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE cast(event_id % 9 AS int) END AS pattern_id,
  cast(user_id % 10 AS int) AS project_id,
  cast(event_id % 300 AS int) AS scan_id,
  ts AS detected_at
FROM events""",
    "v_projects": """
SELECT cast(c_custkey AS int) AS id, c_name AS name, c_acctbal > 0 AS active,
  CASE cast(c_custkey % 3 AS int) WHEN 0 THEN 'python' WHEN 1 THEN 'java' ELSE 'c' END AS main_language
FROM customer""",
    "v_scans": """
SELECT o_orderkey AS id, cast(o_custkey % 10 AS int) AS project_id, o_orderdate AS start_time,
  cast(floor(o_totalprice) AS int) AS lines_scanned,
  cast(o_orderkey % 50 AS int) AS duration_seconds,
  cast(o_orderkey % 17 AS int) AS total_vulnerabilities,
  cast(o_orderkey % 5 AS int) AS critical_count
FROM orders""",
    "v_feedback": """
SELECT concat('DET-', lpad(cast(event_id AS string), 8, '0')) AS detection_id, event_id AS seq,
  CASE event_type WHEN 'error' THEN 'SQL Injection' WHEN 'purchase' THEN 'Command Injection'
       WHEN 'click' THEN 'XSS' WHEN 'view' THEN 'Path Traversal' ELSE 'Insecure Deserialization' END AS vulnerability_type,
  (event_id * 7 + user_id) % 10 < CASE event_type WHEN 'error' THEN 9 WHEN 'purchase' THEN 7
       WHEN 'click' THEN 5 WHEN 'view' THEN 3 ELSE 8 END AS was_correct,
  least(value / cast(100 AS double), cast(1 AS double)) AS original_confidence,
  CASE WHEN event_id % 2500 = 0 THEN 'gnn' WHEN user_id % 3 = 0 THEN 'pattern'
       WHEN user_id % 3 = 1 THEN 'ast' ELSE 'hybrid' END AS detection_method,
  CASE cast(event_id % 6 AS int)
    WHEN 0 THEN concat('sql = "SELECT c', cast(user_id % 9 AS string), ' FROM t" + uid')
    WHEN 1 THEN concat('os.system("ls " + path', cast(user_id % 9 AS string), ')')
    WHEN 2 THEN 'node.innerHTML = request.body'
    WHEN 3 THEN concat('data = open(base + name', cast(user_id % 9 AS string), ').read()')
    WHEN 4 THEN 'obj = pickle.loads(payload)  # check later'
    ELSE 'value = sanitize(user_input)' END AS code_snippet,
  ts AS feedback_ts
FROM events""",
    "v_code_files": f"""
SELECT p.p_partkey AS file_id, t.language,
  concat(CASE WHEN p.p_partkey % 11 = 0 THEN 'tests/test_f' ELSE 'app/f' END, cast(p.p_partkey AS string), t.ext) AS file_path,
  replace(replace(t.body, '@N', cast(p.p_size AS string)), '~', chr(10)) AS content
FROM part p JOIN ({_template_sql()}) t ON p.p_partkey % 8 = t.k""",
    "v_code_updates": """
SELECT concat('client-', cast(conv_id % 20 AS string)) AS client_id,
  concat('live/f', cast(conv_id AS string), '.py') AS file_path,
  turn * 2 AS seq, conv_id * 60000 + turn * 250 AS ts_ms, text AS code
FROM conversations
UNION ALL
SELECT concat('client-', cast(conv_id % 20 AS string)), concat('live/f', cast(conv_id AS string), '.py'),
  turn * 2 + 1, conv_id * 60000 + turn * 250 + 100, text
FROM conversations WHERE turn % 3 = 0""",
    "v_patterns_vec": """
SELECT concat('P-', cast(e.vec_id AS string)) AS pattern_id, e.label AS type_id,
  CASE WHEN e.vec_id % 10 < 3 THEN 'known' WHEN e.vec_id % 10 = 3 THEN 'mutation' ELSE 'query' END AS part_role,
  CASE WHEN e.vec_id % 10 < 3 THEN e.embedding
       ELSE list_concat(list_slice(k.embedding, 1, 64 - e.vec_id % 40),
                        list_slice(e.embedding, 65 - e.vec_id % 40, 64)) END AS embedding
FROM embeddings e JOIN embeddings k ON k.vec_id = e.vec_id - e.vec_id % 10 + e.vec_id % 3""",
    "v_labelled": """
SELECT d.doc_id AS file_id, d.lang AS language,
  concat('CWE-', CASE cast(d.doc_id % 6 AS int) WHEN 0 THEN '89' WHEN 1 THEN '79' WHEN 2 THEN '78'
         WHEN 3 THEN '22' WHEN 4 THEN '190' ELSE '999' END) AS cwe_id,
  d.text AS code, l.quality AS label,
  CASE WHEN l.toxic = 1 OR d.doc_id % 9 = 0 THEN 1 - l.quality ELSE l.quality END AS predicted,
  cast(d.n_chars % 100 AS double) / cast(100 AS double) AS confidence
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "v_model_scores": """
SELECT file_id, file_path, language,
  CASE cast(file_id % 5 AS int) WHEN 0 THEN 'SQL Injection' WHEN 1 THEN 'XSS' WHEN 2 THEN 'Command Injection'
       WHEN 3 THEN 'Path Traversal' ELSE 'Insecure Deserialization' END AS vulnerability_type,
  cast(file_id * 37 % 100 AS double) / cast(100 AS double) AS score,
  cast(file_id * 53 % 100 AS double) / cast(100 AS double) AS type_confidence,
  cast(file_id * 71 % 40 AS double) / cast(100 AS double) AS graph_density
FROM v_code_files""",
}
