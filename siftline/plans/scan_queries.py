"""Queries that scan the corpus and describe its files."""
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from .. import views as V
from ..functions import language as L
from ..functions import text as T
from ..operators import analytics as A
from ..operators import findings as O
from ..operators import model_findings as M
from ..operators import scan as C
from ..operators import segments as S
from ..session import new_run_folder
from ..sources import files as files_source
from ..sources.rules import regex_table, rule_table
from .registry import (SQL_BLANK, query, sql_any, sql_count, sql_list, sql_strip, sql_text, sql_values)

LINES_CTE = """lines AS (SELECT file_id, file_path, language, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no,
  unnest(string_split(content, chr(10))) AS line FROM v_code_files)"""
COMMENT_SQL = f"""((language = 'python' AND starts_with({sql_strip('line')}, '#'))
  OR (language IN ('javascript','java','c','cpp') AND starts_with({sql_strip('line')}, '//')))"""
CODE_LINES_CTE = f"""{LINES_CTE}, code_lines AS (SELECT * FROM lines WHERE {sql_strip('line')} <> '' AND NOT {COMMENT_SQL})"""
KB_CTE = ", ".join([
    sql_values("kb", ["rule_ord", "rule_id", "name", "description", "severity", "cwe_id", "threshold", "fix"],
               [(i, r["rule_id"], r["name"], r["description"], r["severity"], r["cwe_id"], r["threshold"], r["fix"])
                for i, r in enumerate(fixed.RULES)]),
    sql_values("kb_regex", ["regex_ord", "rule_id", "language", "regex"],
               [(i, *row) for i, row in enumerate(fixed.RULE_REGEXES)]),
    sql_values("kb_alt", ["rule_id", "language", "example"],
               [(r["rule_id"], l, e) for r in fixed.RULES for l, e in r["alternatives"].items()]),
])
MATCH_CONFIDENCE_SQL = f"""least(0.8::DOUBLE
  + CASE WHEN contains(line, '+') AND {sql_any('upper(line)', ['WHERE', 'SELECT'])} THEN 0.15::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN {sql_any('line', ['f"', "f'"])} AND {sql_any('upper(line)', fixed.SQL_WORDS)} THEN 0.1::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN severity = 'critical' THEN 0.05::DOUBLE ELSE 0::DOUBLE END
  - CASE WHEN regexp_matches({sql_strip('line')}, '^(//|#|/\\*|\\*)') THEN 0.4::DOUBLE ELSE 0::DOUBLE END, 1::DOUBLE)"""
RULE_HITS_CTE = f"""{CODE_LINES_CTE}, {KB_CTE}, rule_hits AS (
  SELECT l.*, k.*, x.regex_ord, {MATCH_CONFIDENCE_SQL} AS confidence
  FROM code_lines l JOIN kb_regex x ON l.language = x.language AND regexp_matches(l.line, '(?i)' || x.regex)
  JOIN kb k ON k.rule_id = x.rule_id)"""
FIX_SQL = "CASE WHEN a.example IS NOT NULL THEN concat(h.fix, chr(10), chr(10), 'Example: ', a.example) ELSE h.fix END"
RULE_FINDINGS_CTE = f"""{RULE_HITS_CTE}, rule_findings AS (
  SELECT concat(h.rule_id, '-', h.file_path, '-', h.line_no) AS finding_id, 0 AS analyzer_ord, h.rule_ord, h.regex_ord, h.name,
    h.description, h.severity, h.confidence, h.file_path, h.line_no AS line_start, h.line_no AS line_end,
    {sql_strip('h.line')} AS code_snippet, h.cwe_id, {FIX_SQL} AS fix_suggestion
  FROM rule_hits h LEFT JOIN kb_alt a ON a.rule_id = h.rule_id AND a.language = h.language WHERE h.confidence >= h.threshold)"""
KEYWORDS_CTE = ", ".join([
    sql_values("kw", ["keyword_ord", "language", "keyword", "risk"],
               [(i, *row) for i, row in enumerate(fixed.KEYWORD_RISKS)]),
    sql_values("kw_cwe", ["keyword", "cwe_id"], list(fixed.KEYWORD_CWE.items())),
    sql_values("kw_fix", ["keyword", "fix"], list(fixed.KEYWORD_FIX.items())),
])
KEYWORD_FINDINGS_CTE = f"""{KEYWORDS_CTE}, keyword_hits AS (
  SELECT l.*, k.keyword_ord, k.keyword, k.risk FROM lines l JOIN kw k ON l.language = k.language WHERE NOT {COMMENT_SQL.replace('language', 'l.language')}
  AND CASE WHEN k.keyword = 'exec' THEN l.language = 'python' AND regexp_matches(l.line, '\\bexec\\s*\\(') AND NOT regexp_matches(l.line, '\\.\\s*execute\\s*\\(')
    WHEN k.keyword = 'subprocess.call' THEN contains(l.line, k.keyword) AND contains(l.line, 'shell=True')
    WHEN k.keyword = 'eval' THEN regexp_matches(l.line, '\\beval\\s*\\(') ELSE contains(l.line, k.keyword) END),
keyword_findings AS (
  SELECT concat('PARSE-', upper(h.language), '-', lpad(cast(line_no AS varchar), cast(greatest(4, length(cast(line_no AS varchar))) AS int), '0')) AS finding_id, 1 AS analyzer_ord, 0 AS rule_ord,
    keyword_ord AS regex_ord, concat(h.keyword, ' vulnerability') AS name, risk AS description,
    CASE WHEN contains(risk, 'injection') THEN 'high' ELSE 'medium' END AS severity, 0.85::DOUBLE AS confidence, file_path,
    line_no AS line_start, line_no AS line_end, {sql_strip('line')} AS code_snippet, coalesce(c.cwe_id, 'CWE-Unknown') AS cwe_id,
    coalesce(f.fix, 'Review and sanitize all user inputs') AS fix_suggestion
  FROM keyword_hits h LEFT JOIN kw_cwe c ON c.keyword = h.keyword LEFT JOIN kw_fix f ON f.keyword = h.keyword)"""
ALL_FINDINGS_CTE = f"{RULE_FINDINGS_CTE}, {KEYWORD_FINDINGS_CTE}, all_findings AS (SELECT * FROM rule_findings UNION ALL SELECT * FROM keyword_findings)"
FIRST_SQL = "SELECT * FROM all_findings QUALIFY row_number() OVER (PARTITION BY file_path, line_start, name ORDER BY analyzer_ord, rule_ord, regex_ord) = 1"
SHOWN = ["finding_id", "name", "description", "severity", "confidence", "file_path", "line_start", "line_end",
         "code_snippet", "cwe_id", "fix_suggestion"]
SHOWN_SQL = "finding_id, name, description, severity, round(confidence, 4) AS confidence, file_path, line_start, line_end, code_snippet, cwe_id, fix_suggestion"


def shown(findings):
    return findings.select(*[F.round(c, 4).alias(c) if c == "confidence" else c for c in SHOWN])


def all_findings(spark, folder):
    files = V.code_files(spark, folder)
    return C.scanned_findings(files)


@query("scan_severity_counts", f"""
WITH {ALL_FINDINGS_CTE}, d AS ({FIRST_SQL}) SELECT severity, count(*) AS count, round(avg(confidence), 4) AS avg_confidence FROM d GROUP BY severity""")
def scan_severity_counts(spark, folder):
    found = C.first_per_place(all_findings(spark, folder)).withColumnRenamed("confidence", "confidence_score")
    return A.severity_distribution(found).withColumn("avg_confidence", F.round("avg_confidence", 4))


@query("code_lines", f"WITH {CODE_LINES_CTE} SELECT file_id, line_no, line FROM code_lines")
def code_lines(spark, folder):
    return C.code_lines(V.code_files(spark, folder)).select("file_id", "line_no", "line")


@query("rule_scan", f"WITH {RULE_FINDINGS_CTE} SELECT {SHOWN_SQL}, regex_ord FROM rule_findings")
def rule_scan(spark, folder):
    found = C.rule_findings(V.code_files(spark, folder))
    return found.select(*[F.round(c, 4).alias(c) if c == "confidence" else c for c in [*SHOWN, "regex_ord"]])


@query("match_confidence", f"WITH {RULE_HITS_CTE} SELECT file_id, line_no, regex_ord, round(confidence, 4) AS confidence, confidence >= threshold AS reported FROM rule_hits")
def match_confidence(spark, folder):
    hits = C.rule_hits(V.code_files(spark, folder))
    return hits.select("file_id", "line_no", "regex_ord", F.round("confidence", 4).alias("confidence"),
                       (F.col("confidence") >= F.col("threshold")).alias("reported"))


@query("keyword_scan", f"WITH {LINES_CTE}, {KEYWORD_FINDINGS_CTE} SELECT {SHOWN_SQL} FROM keyword_findings")
def keyword_scan(spark, folder):
    return shown(C.keyword_findings(V.code_files(spark, folder)))


@query("cwe_fix_lookup", f"""
WITH {LINES_CTE}, {KEYWORD_FINDINGS_CTE} SELECT name, cwe_id, fix_suggestion, count(*) AS findings FROM keyword_findings GROUP BY ALL""")
def cwe_fix_lookup(spark, folder):
    found = C.keyword_findings(V.code_files(spark, folder))
    return found.groupBy("name", "cwe_id", "fix_suggestion").agg(F.count("*").alias("findings"))


@query("all_findings", f"WITH {ALL_FINDINGS_CTE} SELECT {SHOWN_SQL} FROM all_findings")
def all_findings_query(spark, folder):
    return shown(all_findings(spark, folder))


@query("dedupe_first", f"WITH {ALL_FINDINGS_CTE} SELECT {SHOWN_SQL} FROM ({FIRST_SQL})")
def dedupe_first(spark, folder):
    return shown(C.first_per_place(all_findings(spark, folder)))


def _rated(spark, folder):
    """Stored findings with an explanation on some, several per (file, line, severity)."""
    explained = F.when(F.col("project_id") < 4, F.lit(None)).when(F.col("project_id") < 7, "rule text").otherwise(f"rule text{fixed.ENRICHED_OPENING}detail")
    return V.detections(spark, folder).select(
        "id", "file_path", "line_start", F.col("severity").alias("name"),
        F.round("confidence_score", 1).alias("confidence"), F.col("id").alias("regex_ord"), explained.alias("ai_explanation"))


@query("dedupe_best", """
WITH r AS (SELECT id, file_path, line_start, severity AS name, round(confidence_score, 1) AS confidence,
    CASE WHEN project_id < 4 THEN NULL WHEN project_id < 7 THEN 'rule text' ELSE 'marked' END AS x FROM v_detections),
  m AS (SELECT *, max(confidence) OVER p AS best FROM r WINDOW p AS (PARTITION BY file_path, line_start, name)),
  t AS (SELECT *, first_value(x) OVER w AS first_x, row_number() OVER w AS n FROM m WHERE confidence = best
    WINDOW w AS (PARTITION BY file_path, line_start, name ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  o AS (SELECT *, row_number() OVER (PARTITION BY file_path, line_start, name ORDER BY
    CASE WHEN first_x = 'rule text' AND x = 'marked' THEN 0 ELSE 1 END, n) AS pick FROM t)
SELECT id, file_path, line_start, name, confidence, x AS ai_explanation FROM o WHERE pick = 1""")
def dedupe_best(spark, folder):
    best = C.best_per_place(_rated(spark, folder))
    return best.select("id", "file_path", "line_start", "name", "confidence",
                       F.when(F.contains("ai_explanation", F.lit(fixed.ENRICHMENT_MARK)), "marked").otherwise(F.col("ai_explanation")).alias("ai_explanation"))


@query("finding_sink", f"""
WITH {ALL_FINDINGS_CTE}, d AS ({FIRST_SQL})
SELECT concat('DET-', md5(concat_ws('|', file_path, cast(line_start AS varchar), name))) AS detection_id, file_path, line_start,
  line_end, severity, round(confidence, 4) AS confidence_score, code_snippet FROM d""")
def finding_sink(spark, folder):
    stored = O.stored_form(C.first_per_place(all_findings(spark, folder)))
    return stored.drop("ai_explanation").withColumn("confidence_score", F.round("confidence_score", 4))


@query("finding_store", f"""
WITH {ALL_FINDINGS_CTE}, d AS ({FIRST_SQL})
SELECT concat('DET-', md5(concat_ws('|', file_path, cast(line_start AS varchar), name))) AS detection_id, file_path, line_start,
  line_end, severity, round(confidence, 4) AS confidence_score, code_snippet, cast(DATE '2024-01-01' + CAST(line_start % 3 AS INT) AS date) AS day FROM d""")
def finding_store(spark, folder):
    """The table after a scan of every other file, a scan of all, and the same scan again: each finding once."""
    path = new_run_folder(spark, "findings")
    found = C.first_per_place(all_findings(spark, folder))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("line_start") % 3)
    for part in (found.filter(F.crc32("file_path") % 2 == 0), found, found):
        O.append_findings(part, path, day)
    stored = O.read_findings(spark, path)
    return stored.drop("ai_explanation").withColumn("confidence_score", F.round("confidence_score", 4))


@query("create_scans", f"""
SELECT DISTINCT concat('SCAN-', md5(concat_ws('|', project_id, CASE WHEN id % 2 = 0 THEN 'quick' ELSE 'full' END, start_time))) AS scan_id, project_id,
  CASE WHEN id % 2 = 0 THEN 'quick' ELSE 'full' END AS scan_type, {V.AS_OF_SQL} AS start_time, 0 AS total_vulnerabilities FROM v_scans""")
def create_scans(spark, folder):
    """A scan per request; projects ask daily, often more than once, which names one scan."""
    s = V.scans(spark, folder)
    requests = s.select("project_id", F.when(F.col("id") % 2 == 0, "quick").alias("scan_type"), F.col("start_time").cast("string").alias("seq"))
    return O.create_scans(requests, V.as_of()).drop("end_time")


@query("rule_kb_exploded", f"""
WITH {KB_CTE}, f AS (SELECT language, count(*) AS files FROM v_code_files GROUP BY language)
SELECT k.rule_id, x.language, x.regex_ord, x.regex, k.severity, k.threshold, coalesce(f.files, 0) AS files
FROM kb_regex x JOIN kb k ON k.rule_id = x.rule_id LEFT JOIN f ON f.language = x.language""")
def rule_kb_exploded(spark, folder):
    """Every regex with the number of corpus files it applies to."""
    files = V.code_files(spark, folder).groupBy("language").agg(F.count("*").alias("files"))
    rules = rule_table(spark).select("rule_id", "severity", "threshold")
    per_regex = regex_table(spark).join(F.broadcast(rules), "rule_id").join(files, "language", "left")
    return per_regex.select("rule_id", "language", "regex_ord", "regex", "severity", "threshold",
                            F.coalesce("files", F.lit(0)).alias("files"))


@query("fix_suggestion", f"""
WITH {KB_CTE}, l AS (SELECT rule_id, language FROM (SELECT DISTINCT rule_id, language FROM kb_regex))
SELECT f.file_id, h.rule_id, {FIX_SQL} AS fix_suggestion FROM v_code_files f JOIN l ON l.language = f.language JOIN kb h ON h.rule_id = l.rule_id
LEFT JOIN kb_alt a ON a.rule_id = h.rule_id AND a.language = f.language""")
def fix_suggestion(spark, folder):
    rules = rule_table(spark).select("rule_id", "fix", "alternatives", F.explode("languages").alias("language"))
    joined = V.code_files(spark, folder).join(F.broadcast(rules), "language")
    return joined.select("file_id", "rule_id", C.fix_text(F.col("fix"), F.col("alternatives"), F.col("language")).alias("fix_suggestion"))


SIGNATURE_SQL = [
    (language, " + ".join(f"cast(contains(t, {sql_text(s.lower())}) AS int)" for s in signatures))
    for language, signatures in fixed.CONTENT_SIGNATURES.items()
]
CONTENT_CTE = ("sig AS (SELECT *, " + ", ".join(f"{score} AS s_{language}" for language, score in SIGNATURE_SQL)
               + " FROM texts), best AS (SELECT *, greatest(" + ", ".join(f"s_{l}" for l, _ in SIGNATURE_SQL) + ") AS top FROM sig)")
CONTENT_PICK = ("CASE WHEN top = 0 THEN NULL " + " ".join(f"WHEN s_{l} = top THEN '{l}'" for l, _ in SIGNATURE_SQL) + " END")


@query("detect_lang_ext", f"""
WITH {sql_values("ext", ["suffix", "language"], list(fixed.EXTENSION_LANGUAGE.items()))},
p AS (SELECT id, file_path, lower(regexp_extract(file_path, '.(\\.[^./]+)$', 1)) AS suffix FROM (
  SELECT id, CASE WHEN line_start % 5 = 0 THEN upper(file_path) WHEN line_start % 7 = 0 THEN concat(file_path, 'x') ELSE file_path END AS file_path FROM v_detections))
SELECT p.id, p.file_path, ext.language FROM p LEFT JOIN ext ON ext.suffix = p.suffix""")
def detect_lang_ext(spark, folder):
    path = F.when(F.col("line_start") % 5 == 0, F.upper("file_path")).when(
        F.col("line_start") % 7 == 0, F.concat("file_path", F.lit("x"))).otherwise(F.col("file_path"))
    named = V.detections(spark, folder).select("id", path.alias("file_path"))
    return named.withColumn("language", L.from_extension(F.col("file_path")))


@query("detect_lang_content", f"""
WITH texts AS (SELECT 'file' AS kind, file_id AS id, lower(content) AS t FROM v_code_files
  UNION ALL SELECT 'document', doc_id, lower(text) FROM documents), {CONTENT_CTE}
SELECT kind, id, {CONTENT_PICK} AS language FROM best""")
def detect_lang_content(spark, folder):
    code = V.code_files(spark, folder).select(F.lit("file").alias("kind"), F.col("file_id").alias("id"), F.col("content").alias("text"))
    docs = V.documents(spark, folder).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    return code.unionByName(docs).select("kind", "id", L.from_content(F.col("text")).alias("language"))


@query("supported_files", f"""
WITH {sql_values("ext", ["suffix", "language"], list(fixed.EXTENSION_LANGUAGE.items()))},
named AS (SELECT doc_id, text, concat('in/', doc_id, CASE WHEN length(source) % 2 = 0 THEN '.txt' ELSE '.CC' END) AS file_path FROM documents),
texts AS (SELECT doc_id, file_path, lower(text) AS t, lower(regexp_extract(file_path, '.(\\.[^./]+)$', 1)) AS suffix FROM named), {CONTENT_CTE}
SELECT doc_id, file_path, coalesce(ext.language, {CONTENT_PICK}) AS language FROM best LEFT JOIN ext ON ext.suffix = best.suffix
WHERE coalesce(ext.language, {CONTENT_PICK}) IS NOT NULL""")
def supported_files(spark, folder):
    """Whole texts are read for signatures."""
    ending = F.when(F.length("source") % 2 == 0, ".txt").otherwise(".CC")
    files = V.documents(spark, folder).select(
        "doc_id", F.concat(F.lit("in/"), F.col("doc_id").cast("string"), ending).alias("file_path"), F.col("text").alias("content"))
    return files_source.with_language(files).select("doc_id", "file_path", "language")


@query("scan_code_corpus", f"""
WITH {RULE_FINDINGS_CTE}, d AS (SELECT DISTINCT file_path, line_start, name FROM rule_findings)
SELECT f.file_path, f.language, cast(length(f.content) AS bigint) AS chars, count(d.name) AS findings
FROM v_code_files f LEFT JOIN d ON d.file_path = f.file_path GROUP BY ALL""")
def scan_code_corpus(spark, folder):
    """The corpus written as a tree of files, read back from the tree and scanned.

    The files are dealt to folders by name, as a folder is listed in one task.
    """
    tree = new_run_folder(spark, "tree")
    corpus = V.code_files(spark, folder)
    shards = -(-corpus.count() // files_source.TASK_FILES) or 1
    shard = F.pmod(F.xxhash64("file_path"), F.lit(shards)).cast("string")
    written = files_source.write_tree(corpus.withColumn("file_path", F.concat(shard, F.lit("/"), F.col("file_path"))), tree)
    written.write.parquet(new_run_folder(spark, "tree-manifest"))
    files = files_source.with_language(files_source.read_tree(spark, tree))
    files = files.withColumn("file_path", F.regexp_extract("file_path", r"/tree-[0-9a-f]+/[0-9]+/(.*)$", 1))
    found = C.rule_findings(files.withColumn("file_id", F.xxhash64("file_path"))).select("file_path", "line_start", "name").distinct().groupBy("file_path").agg(F.count("*").alias("findings"))
    return files.join(found, "file_path", "left").select(
        "file_path", "language", F.length("content").cast("long").alias("chars"), F.coalesce("findings", F.lit(0)).alias("findings"))


@query("scan_snippets", f"""
WITH texts AS (SELECT file_id, content, lower(content) AS t FROM v_code_files), {CONTENT_CTE},
src AS (SELECT file_id, 'quick_scan.tmp' AS file_path, {CONTENT_PICK} AS language, content FROM best),
lines AS (SELECT file_id, file_path, language, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no,
  unnest(string_split(content, chr(10))) AS line FROM src),
code_lines AS (SELECT * FROM lines WHERE {sql_strip('line')} <> '' AND NOT {COMMENT_SQL}),
{KB_CTE}, rule_hits AS (SELECT l.*, k.*, x.regex_ord, {MATCH_CONFIDENCE_SQL} AS confidence
  FROM code_lines l JOIN kb_regex x ON l.language = x.language AND regexp_matches(l.line, '(?i)' || x.regex) JOIN kb k ON k.rule_id = x.rule_id)
SELECT file_id, language, rule_id, line_no AS line_start, regex_ord, round(confidence, 4) AS confidence FROM rule_hits WHERE confidence >= threshold""")
def scan_snippets(spark, folder):
    code = V.code_files(spark, folder).select("file_id", F.col("content").alias("code"), F.lit(None).cast("string").alias("language"))
    hits = C.rule_hits(files_source.snippets(code)).filter(F.col("confidence") >= F.col("threshold"))
    return hits.select("file_id", "language", "rule_id", F.col("line_no").alias("line_start"), "regex_ord",
                       F.round("confidence", 4).alias("confidence"))


BLOCK_START_SQL = sql_any("line", fixed.BLOCK_STARTS)


def blocks_sql(source, key, close):
    """Blocks by windows over exploded lines; ``close`` adds the blank-line ending and the whole-file fallback."""
    ending = f"min(CASE WHEN {sql_strip('line')} = '' AND rn > 3 THEN rn END) OVER (PARTITION BY {key}, g)" if close else "NULL"
    fallback = (f" UNION ALL SELECT {key}, 1, len(string_split(content, chr(10))), content FROM {source} WHERE {key} NOT IN (SELECT {key} FROM g3)"
                if close else "")
    return f"""g0 AS (SELECT {key}, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no, unnest(string_split(content, chr(10))) AS line FROM {source}),
g1 AS (SELECT *, sum(CASE WHEN {BLOCK_START_SQL} THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY line_no) AS g FROM g0),
g2 AS (SELECT *, row_number() OVER (PARTITION BY {key}, g ORDER BY line_no) AS rn FROM g1 WHERE g > 0),
g3 AS (SELECT *, {ending} AS ending FROM g2),
blocks AS (SELECT {key}, min(line_no) AS start_line, count(*) AS line_count, string_agg(line, chr(10) ORDER BY line_no) AS code
  FROM g3 WHERE ending IS NULL OR rn <= ending GROUP BY {key}, g{fallback})"""


@query("function_blocks", f"WITH {blocks_sql('v_code_files', 'file_id', True)} SELECT file_id, start_line, line_count, code FROM blocks")
def function_blocks(spark, folder):
    return S.function_blocks(V.code_files(spark, folder), "file_id").select("file_id", "start_line", "line_count", "code")


@query("function_segments", f"WITH {blocks_sql('v_code_files', 'file_id', False)} SELECT file_id, start_line, code FROM blocks")
def function_segments(spark, folder):
    return S.function_segments(V.code_files(spark, folder), "file_id").select("file_id", "start_line", "code")


@query("multiline_segments")
def multiline_segments(spark, folder):
    return S.multiline_segments(V.code_files(spark, folder), "file_id")


DOC_FILES_CTE = "doc_files AS (SELECT doc_id, concat('doc/', doc_id) AS file_path, text AS content FROM documents)"


@query("complex_blocks", f"""
WITH {DOC_FILES_CTE}, {blocks_sql('doc_files', 'doc_id', True)},
c AS (SELECT *, len(regexp_extract_all(code, '\\b(if|while|for|switch|case|catch)\\b')) + 1 AS complexity,
  CASE WHEN regexp_extract(code, '([\\p{{L}}\\p{{N}}_]+)\\s*\\(', 1) <> '' THEN regexp_extract(code, '([\\p{{L}}\\p{{N}}_]+)\\s*\\(', 1) ELSE 'block' END AS fn FROM blocks)
SELECT concat('COMPLEX-', fn, '-', start_line) AS finding_id, concat('High complexity in ', fn) AS name,
  concat('Function has cyclomatic complexity of ', complexity) AS description, concat('doc/', doc_id) AS file_path,
  start_line AS line_start, start_line + line_count - 1 AS line_end,
  code AS code_snippet FROM c WHERE complexity > 10""")
def complex_blocks(spark, folder):
    docs = V.documents(spark, folder).select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("content"))
    return S.complexity_findings(docs).select(
        "finding_id", "name", "description", "file_path", "line_start", "line_end", "code_snippet")


@query("keyword_complexity", f"""
SELECT doc_id, cast(1 + {' + '.join(sql_count('text', w) for w in fixed.COMPLEXITY_WORDS)} AS int) AS complexity FROM documents""")
def keyword_complexity(spark, folder):
    return V.documents(spark, folder).select("doc_id", S.keyword_complexity(F.col("text")).alias("complexity"))


LABELLED_SQL = f"({sql_any('line', fixed.LABELLED_LINE_LITERALS)} OR regexp_matches(line, {sql_text(fixed.LABELLED_LINE_REGEX)}))"


@query("labelled_lines", f"""
WITH {LINES_CTE}, h AS (SELECT file_id, string_agg(cast(line_no AS varchar), ',' ORDER BY line_no) AS line_numbers FROM lines WHERE {LABELLED_SQL} GROUP BY file_id)
SELECT f.file_id, coalesce(h.line_numbers, '') AS line_numbers FROM v_code_files f LEFT JOIN h ON h.file_id = f.file_id""")
def labelled_lines(spark, folder):
    numbers = F.array_join(S.labelled_lines(F.col("content")).cast("array<string>"), ",")
    return V.code_files(spark, folder).select("file_id", numbers.alias("line_numbers"))


TYPE_WORDS_CTE = sql_values("type_words", ["kind", "word"], [(k, w) for k, words in fixed.TYPE_LINE_KEYWORDS.items() for w in words])
LOCATED_CTE = f"""{LINES_CTE}, {TYPE_WORDS_CTE}, hit AS (SELECT DISTINCT l.file_id, l.line_no FROM lines l JOIN v_model_scores s ON s.file_id = l.file_id
  JOIN type_words w ON w.kind = s.vulnerability_type AND contains(l.line, w.word)),
agg AS (SELECT file_id, string_agg(cast(line_no AS varchar), ',' ORDER BY line_no) AS line_numbers, min(line_no) AS lo, max(line_no) AS hi FROM hit GROUP BY file_id),
located AS (SELECT s.*, f.content, coalesce(a.line_numbers, '1') AS line_numbers, coalesce(a.lo, 1) AS lo, coalesce(a.hi, 1) AS hi
  FROM v_model_scores s JOIN v_code_files f ON f.file_id = s.file_id LEFT JOIN agg a ON a.file_id = s.file_id),
snips AS (SELECT *, array_to_string(list_slice(string_split(content, chr(10)), greatest(0, lo - 3) + 1, least(len(string_split(content, chr(10))), hi + 2)), chr(10)) AS snip FROM located)"""


def scored_files(spark, folder):
    """Model scores with the file's text: both are narrow projections of one table."""
    scores = V.model_scores(spark, folder).drop("file_path", "language")
    return V.code_files(spark, folder).join(scores, "file_id")


@query("vuln_line_locator", f"WITH {LOCATED_CTE} SELECT file_id, vulnerability_type, line_numbers FROM located")
def vuln_line_locator(spark, folder):
    numbers = S.vulnerable_lines(F.col("content"), F.col("vulnerability_type"))
    return scored_files(spark, folder).select(
        "file_id", "vulnerability_type", F.array_join(numbers.cast("array<string>"), ",").alias("line_numbers"))


@query("context_snippet", f"""
WITH {LOCATED_CTE} SELECT file_id, snip AS snippet FROM snips""")
def context_snippet(spark, folder):
    numbered = scored_files(spark, folder).withColumn("_lines", S.vulnerable_lines(F.col("content"), F.col("vulnerability_type")))
    return numbered.select("file_id", S.context_snippet(F.col("content"), F.col("_lines"), "...").alias("snippet"))


CTX = [("has_user_input", "lower(text)", fixed.CONTEXT_INPUT_WORDS), ("has_validation", "text", fixed.CONTEXT_VALIDATION_WORDS),
       ("has_error_handling", "text", fixed.CONTEXT_ERROR_WORDS)]
TEXTS_CTE = "texts AS (SELECT 'file' AS kind, file_id AS id, content AS text FROM v_code_files UNION ALL SELECT 'document', doc_id, text FROM documents)"
SQL_LINE_COUNT = "(length(text) - length(replace(text, chr(10), '')) + 1)"


def texts(spark, folder):
    code = V.code_files(spark, folder).select(F.lit("file").alias("kind"), F.col("file_id").alias("id"), F.col("content").alias("text"))
    docs = V.documents(spark, folder).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    return code.unionByName(docs)


@query("code_context", f"""WITH {TEXTS_CTE} SELECT kind, id, {SQL_LINE_COUNT} AS lines_of_code,
{', '.join(f'{sql_any(col, words)} AS {name}' for name, col, words in CTX)} FROM texts""")
def code_context(spark, folder):
    return texts(spark, folder).select("kind", "id", *[c.alias(n) for n, c in S.code_context(F.col("text")).items()])


@query("risk_tier", f"""WITH {TEXTS_CTE} SELECT kind, id, CASE
{' '.join(f"WHEN {sql_any('lower(text)', words)} THEN '{level}: {fixed.RISK_TEXT}'" for level, words in fixed.RISK_WORDS)}
ELSE '{fixed.LOW_RISK_TEXT}' END AS risk FROM texts""")
def risk_tier(spark, folder):
    return texts(spark, folder).select("kind", "id", S.risk_tier(F.col("text")).alias("risk"))


@query("predict_cwe", f"""WITH {TEXTS_CTE} SELECT kind, id, CASE
{' '.join(f"WHEN {sql_any('lower(text)', words)} THEN '{cwe}'" for cwe, words in fixed.CWE_WORDS)} END AS cwe FROM texts""")
def predict_cwe(spark, folder):
    return texts(spark, folder).select("kind", "id", S.predicted_cwe(F.col("text")).alias("cwe"))


@query("segment_features", f"""WITH {TEXTS_CTE} SELECT kind, id, length(text) AS length, {SQL_LINE_COUNT} - 1 AS newlines,
len(list_distinct(list_filter(regexp_split_to_array(text, '{SQL_BLANK}+'), lambda w: w <> ''))) AS distinct_words,
length(text) - length(translate(text, '()[]{{}}', '')) AS brackets,
len(list_filter(string_split(text, chr(10)), lambda l: starts_with({sql_strip('l')}, '#'))) AS hash_lines,
{', '.join(f"{sql_any('lower(text)' if folded else 'text', words)} AS {name}" for name, words, folded in fixed.SEGMENT_FLAG_WORDS)} FROM texts""")
def segment_features(spark, folder):
    return texts(spark, folder).select("kind", "id", *[c.alias(n) for n, c in S.segment_statistics(F.col("text")).items()])


@query("explanations", """
SELECT file_id, concat('Graph Neural Network analysis using trained GNN model detected patterns consistent with ', vulnerability_type,
  '. Confidence: ', cast(cast(round(score * 100) AS int) AS varchar), '%. ', CASE WHEN graph_density > 0.5 THEN 'The code has high structural complexity. ' ELSE '' END,
  CASE WHEN graph_density > 0.2 THEN concat(cast(cast(round(graph_density * 100) AS int) AS varchar), '% of code nodes show suspicious patterns. ') ELSE '' END,
  'The GNN identified structural relationships between code elements that match learned vulnerability patterns.') AS graph_text,
  concat('AI Analysis: This code is ', cast(cast(round(score * 100) AS int) AS varchar), '% similar to a known ', vulnerability_type, ' vulnerability. ',
  CASE WHEN score > 0.7 THEN 'The pattern strongly matches known vulnerable code structures. ' ELSE '' END, 'Confidence level: ',
  cast(cast(round(type_confidence * 100) AS int) AS varchar), '%. ', CASE WHEN type_confidence > 0.85 THEN 'High probability of vulnerability - immediate review recommended.'
  WHEN type_confidence > 0.75 THEN 'Moderate probability - manual review advised.' ELSE '' END) AS similarity_text FROM v_model_scores""")
def explanations(spark, folder):
    s = V.model_scores(spark, folder)
    kind, score, density = F.col("vulnerability_type"), F.col("score"), F.col("graph_density")
    return s.select("file_id", M.graph_explanation(kind, score, density, density, True).alias("graph_text"),
                    M.similarity_explanation(kind, score, score > 0.7, F.col("type_confidence")).alias("similarity_text"))


@query("content_hash", f"""
SELECT file_id, md5(concat(language, ':', content)) AS code_key, md5(content) AS version_key,
  md5(concat(content, ':', language, ':', cast(file_id AS varchar))) AS explanation_key FROM v_code_files""")
def content_hash(spark, folder):
    return V.code_files(spark, folder).select(
        "file_id", T.code_key(F.col("language"), F.col("content")).alias("code_key"), F.md5("content").alias("version_key"),
        T.finding_key(F.col("content"), F.col("language"), F.col("file_id")).alias("explanation_key"))
