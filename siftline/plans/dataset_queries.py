"""Queries over labelled data, explanations and stored side tables."""
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from .. import views as V
from ..functions import text as T
from ..operators import analytics as A
from ..operators import analyzers as Az
from ..operators import dataset as D
from ..operators import enrich as E
from ..operators import graph as G
from ..operators import scan as C
from ..operators import learning as Learn
from ..session import new_run_folder, unfolded
from ..sources import stored
from .learning_queries import sql_hash
from .registry import query, sql_any, sql_values

EVAL_SQL = """count(*) FILTER (label = 1 AND predicted = 1) AS true_positives, count(*) FILTER (label = 0 AND predicted = 1) AS false_positives,
count(*) FILTER (label = 1 AND predicted = 0) AS false_negatives, count(*) FILTER (label = 0 AND predicted = 0) AS true_negatives, avg(confidence) AS c"""
RATIO_SQL = """true_positives, false_positives, false_negatives, true_negatives,
round((true_positives + true_negatives) / (true_positives + false_positives + false_negatives + true_negatives), 4) AS accuracy,
round(coalesce(true_positives / nullif(true_positives + false_positives, 0), 0), 4) AS precision, round(coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0), 4) AS recall,
round(coalesce(2 * true_positives / nullif(2 * true_positives + false_positives + false_negatives, 0), 0), 4) AS f1_score,
round(coalesce(true_negatives / nullif(true_negatives + false_positives, 0), 0), 4) AS specificity, round(c, 4) AS avg_confidence"""
RATIOS = ["accuracy", "precision", "recall", "f1_score", "specificity", "avg_confidence"]


def rounded(df, names):
    return df.withColumns({n: F.round(n, 4) for n in names})


@query("classifier_eval", f"WITH m AS (SELECT {EVAL_SQL} FROM v_labelled) SELECT {RATIO_SQL} FROM m")
def classifier_eval(spark, folder):
    return rounded(A.classifier_scores(V.labelled(spark, folder), []), RATIOS)


@query("eval_by_cwe", f"WITH m AS (SELECT cwe_id, {EVAL_SQL} FROM v_labelled GROUP BY cwe_id) SELECT cwe_id, {RATIO_SQL} FROM m")
def eval_by_cwe(spark, folder):
    return rounded(A.classifier_scores(V.labelled(spark, folder), ["cwe_id"]), RATIOS)


SPLIT_CTE = """n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY file_id) AS p FROM v_labelled),
k AS (SELECT CASE WHEN count(*) = 2 THEN min(c) ELSE 0 END AS kept FROM (SELECT count(*) AS c FROM v_labelled GROUP BY label)),
sp AS (SELECT n.*, CASE WHEN p <= floor(kept * 0.8) THEN 'train' ELSE 'test' END AS split FROM n, k WHERE p <= kept)"""


@query("balanced_split", f"WITH {SPLIT_CTE} SELECT file_id, label, split FROM sp")
def balanced_split(spark, folder):
    return D.balanced_split(V.labelled(spark, folder)).select("file_id", "label", "split")


@query("dataset_metadata", f"""
WITH {SPLIT_CTE} SELECT split, count(*) AS total_samples, count(*) FILTER (label = 1) AS vulnerable_samples, string_agg(DISTINCT cwe_id, ',' ORDER BY cwe_id) AS cwe_types,
  string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM sp GROUP BY split""")
def dataset_metadata(spark, folder):
    return D.dataset_metadata(D.balanced_split(V.labelled(spark, folder)))


@query("dataset_sink", f"WITH {SPLIT_CTE} SELECT file_id, label, split, md5(code) AS code_hash FROM sp")
def dataset_sink(spark, folder):
    """The dataset written as JSON and read back."""
    path = new_run_folder(spark, "dataset")
    D.save_dataset(D.balanced_split(V.labelled(spark, folder)), path)
    back = spark.read.schema("file_id long, label int, code string, split string").json(f"{path}/samples")
    return back.select("file_id", "label", "split", F.md5("code").alias("code_hash"))


@query("cwe_type_map", f"""
WITH {sql_values("ct", ["cwe", "type"], list(fixed.CWE_TYPE.items()))}, {sql_values("cc", ["cwe", "class"], list(fixed.CWE_CLASS.items()))}
SELECT file_id, cwe_id, ct.type AS vulnerability_type, coalesce(cc.class, 9) AS class_index FROM v_labelled LEFT JOIN ct ON ct.cwe = cwe_id LEFT JOIN cc ON cc.cwe = cwe_id""")
def cwe_type_map(spark, folder):
    return V.labelled(spark, folder).select(
        "file_id", "cwe_id", D.cwe_type(F.col("cwe_id")).alias("vulnerability_type"), D.cwe_class(F.col("cwe_id")).alias("class_index"))


def _renamed_sql(column):
    text = column
    for old, new in fixed.VARIANT_RENAMES:
        text = f"replace({text}, '{old}', concat('{new}', v))"
    return text


@query("code_variants", f"""
WITH v AS (SELECT file_id, content, unnest([0, 1, 2]) AS v FROM v_code_files)
SELECT concat(file_id, '-v', v) AS file_id, v AS variant, CASE WHEN v = 0 THEN content ELSE {_renamed_sql('content')} END AS code FROM v""")
def code_variants(spark, folder):
    samples = V.code_files(spark, folder).select("file_id", F.col("content").alias("code"))
    return D.code_variants(samples).select("file_id", "variant", "code")


@query("tfidf", """
WITH w AS (SELECT file_id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+')) AS word FROM v_code_files),
c AS (SELECT file_id, word, count(*) AS n FROM w GROUP BY 1, 2), h AS (SELECT word, count(*) AS texts FROM c GROUP BY 1)
SELECT file_id, word, round(n * ln(((SELECT count(*) FROM v_code_files) + 1.0::DOUBLE) / (texts + 1.0::DOUBLE)), 6) AS weight FROM c JOIN h USING (word)""")
def tfidf(spark, folder):
    return D.tfidf(V.code_files(spark, folder)).withColumn("weight", F.round("weight", 6))


def pooled_samples(spark, folder):
    code = V.code_files(spark, folder)
    pooled = G.pooled_vectors(code)
    scores = V.model_scores(spark, folder).select(
        "file_id", (F.col("score") > 0.5).cast("int").alias("label"), (F.col("file_id") % 5).cast("int").alias("kind"))
    return pooled.join(unfolded(scores), "file_id")


@query("graph_classifier")
def graph_classifier(spark, folder):
    data = pooled_samples(spark, folder)
    scored = D.apply_graph_classifier(data, D.train_graph_classifier(data))
    return scored.select("file_id", "label", "kind", F.col("prediction").cast("int").alias("prediction"),
                         F.col("kind_prediction").cast("int").alias("kind_prediction"), F.round("confidence", 6).alias("confidence"))


# --------------------------------------------------------------------- stored side tables

@query("feedback_load", "SELECT seq, detection_id, vulnerability_type, was_correct, round(original_confidence, 6) AS original_confidence, feedback_ts AS timestamp FROM v_feedback")
def feedback_load(spark, folder):
    """Feedback history written as JSON and loaded again."""
    path = new_run_folder(spark, "feedback")
    f = V.feedback(spark, folder)
    stored.save_feedback(f.select(
        "detection_id", "vulnerability_type", "code_snippet", F.lit("unknown").alias("file_path"), F.lit("python").alias("language"),
        "was_correct", F.lit("").alias("user_notes"), "original_confidence", "detection_method",
        F.date_format("feedback_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")), path)
    back = stored.load_feedback(spark, path)
    return back.select(F.substring("detection_id", 5, 20).cast("long").alias("seq"), "detection_id", "vulnerability_type", "was_correct",
                       F.round("original_confidence", 6).alias("original_confidence"), "timestamp")


@query("learned_patterns_io", f"""
SELECT vulnerability_type, arg_min(code_snippet, seq) AS code_example, count(*) AS confirmations, 0.1 AS confidence_boost FROM v_feedback WHERE was_correct GROUP BY vulnerability_type, {sql_hash('code_snippet')}""")
def learned_patterns_io(spark, folder):
    patterns = Learn.patterns_by_structure(V.feedback(spark, folder)).withColumn("confidence_boost", F.lit(0.1))
    patterns = patterns.withColumns({c: F.col(c).cast("string") for c in ("first_seen", "last_seen")})
    back = stored.patterns_from_documents(stored.patterns_document(patterns))
    return back.select("vulnerability_type", "code_example", "confirmations", "confidence_boost")


@query("learned_patterns_file", f"""
SELECT vulnerability_type, arg_min(code_snippet, seq) AS code_example, count(*) + 1 AS confirmations FROM v_feedback WHERE was_correct GROUP BY vulnerability_type, {sql_hash('code_snippet')}""")
def learned_patterns_file(spark, folder):
    """Learned patterns saved, loaded, confirmed once more, saved as the next version and loaded again."""
    path = new_run_folder(spark, "patterns")
    patterns = Learn.patterns_by_structure(V.feedback(spark, folder)).select("vulnerability_type", "code_example", "confirmations")
    stored.save_documents(stored.patterns_document(patterns), path)
    again = stored.patterns_from_documents(stored.load_documents(spark, path))
    stored.save_documents(stored.patterns_document(again.withColumn("confirmations", F.col("confirmations") + 1)), path)
    return stored.patterns_from_documents(stored.load_documents(spark, path)).select("vulnerability_type", "code_example", "confirmations")


@query("history_file", "SELECT vulnerability_type, count(*) FILTER (was_correct) AS correct, count(*) AS total FROM v_feedback GROUP BY 1")
def history_file(spark, folder):
    """Right and all feedback per type, saved as documents and loaded again."""
    path = new_run_folder(spark, "history")
    totals = V.feedback(spark, folder).groupBy("vulnerability_type").agg(F.count_if("was_correct").alias("correct"), F.count("*").alias("total"))
    stored.save_documents(stored.history_document(totals), path)
    return stored.history_from_document(stored.load_documents(spark, path))


@query("manifest_load", f"""
SELECT cast(file_id AS varchar) AS id, cwe_id AS cwe, language, md5(code) AS description FROM v_labelled WHERE {sql_any('cwe_id', list(fixed.CWE_TYPE))}""")
def manifest_load(spark, folder):
    l = V.labelled(spark, folder)
    xml = l.select(F.format_string(
        '<testcase id="%s" cwe="%s" language="%s" url="none">%s</testcase>', F.col("file_id").cast("string"), "cwe_id", "language", F.md5("code")).alias("xml"))
    return stored.case_from_xml(xml, "xml").select("id", "cwe", "language", "description")


# ------------------------------------------------------------------------- explanations

@query("parse_llm_json", f"""
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'A SQL Injection{fixed.FALLBACK_DETAIL}' ELSE text END AS detailed_explanation,
  CASE WHEN doc_id % 4 = 3 THEN 'Review and fix the vulnerable code pattern' ELSE source END AS fix_recommendation, doc_id % 4 <> 3 AS parsed FROM documents""")
def parse_llm_json(spark, folder):
    body = F.to_json(F.struct(F.col("text").alias("detailed_explanation"), F.col("source").alias("fix_recommendation")))
    k = F.col("doc_id") % 4
    answer = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, body).when(
        k == 2, F.concat(F.lit("Here it is: "), body, F.lit(" as asked."))).otherwise("no answer { broken")
    parsed = V.documents(spark, folder).select("doc_id", E.parse_answer(answer).alias("p"))
    e = F.coalesce("p", E.fallback(F.lit("SQL Injection"), F.lit("high")))
    return parsed.select("doc_id", e["detailed_explanation"].alias("detailed_explanation"), e["fix_recommendation"].alias("fix_recommendation"),
                         F.col("p").isNotNull().alias("parsed"))


def findings_with_code(spark, folder):
    f = V.feedback(spark, folder).select("detection_id", F.col("vulnerability_type").alias("name"), "code_snippet")
    d = V.detections(spark, folder).select("id", "detection_id", "severity", "line_start", F.col("confidence_score").alias("confidence"), "detected_at")
    return d.join(f, "detection_id").withColumn("ai_explanation", F.lit(None).cast("string"))


@query("render_prompts", """
SELECT id, md5(concat('You are an expert security researcher analyzing code vulnerabilities. ', chr(10), 'Analyze this python code with a detected ', vulnerability_type, ' vulnerability:', chr(10), chr(10), '```python', chr(10),
  code_snippet, chr(10), '```', chr(10), chr(10), 'Vulnerability Details:', chr(10), '- Type: ', vulnerability_type, chr(10),
  '- Severity: ', severity, chr(10), '- Line: ', line_start)) AS head_hash FROM v_detections d JOIN v_feedback f ON d.detection_id = f.detection_id""")
def render_prompts(spark, folder):
    f = findings_with_code(spark, folder)
    text = E.prompt(F.col("code_snippet"), F.col("name"), F.col("severity"), F.col("line_start"), F.lit("python"))
    return f.select("id", F.md5(F.substring_index(text, "\n\nProvide a security analysis", 1)).alias("head_hash"))


KEY_SQL = "md5(concat(code_snippet, ':', vulnerability_type, ':', line_start))"
CACHE_CTE = f"""b AS (SELECT d.id, d.severity, d.confidence_score, d.detected_at, d.scan_id, f.vulnerability_type, {KEY_SQL} AS key FROM v_detections d JOIN v_feedback f ON d.detection_id = f.detection_id),
ca AS (SELECT key, max(detected_at) AS cached_at FROM b WHERE detected_at > {V.AS_OF_SQL} - INTERVAL 24 HOUR GROUP BY key)"""


def explained(spark, folder, f=None):
    f = findings_with_code(spark, folder) if f is None else f
    key = T.finding_key(F.col("code_snippet"), F.col("name"), F.col("line_start"))
    text = F.concat(F.lit("cached at "), F.col("detected_at").cast("string"))
    entry = F.struct(*[text.alias(c) for c in fixed.EXPLANATION_FIELDS], F.array(F.lit("ref")).alias("references"))
    cache = f.select(key.alias("cache_key"), F.col("detected_at").alias("cached_at"), entry.alias("explanation"))
    return E.with_explanation(f, cache, V.as_of())


@query("explanation_cache", f"""
WITH {CACHE_CTE} SELECT b.id, b.key AS cache_key, ca.key IS NOT NULL AS from_cache,
  CASE WHEN ca.key IS NULL THEN concat('A ', vulnerability_type, '{fixed.FALLBACK_DETAIL}') ELSE 'cached' END AS detailed_explanation
FROM b LEFT JOIN ca ON ca.key = b.key""")
def explanation_cache(spark, folder):
    text = F.col("explanation.detailed_explanation")
    return explained(spark, folder).select("id", "cache_key", "from_cache", F.when(F.col("from_cache"), F.substring_index(text, " ", 1)).otherwise(text).alias("detailed_explanation"))


@query("llm_enrich", f"""
WITH {CACHE_CTE} SELECT b.id, round(least(confidence_score * 1.1, 0.99), 6) AS confidence, CASE WHEN ca.key IS NULL THEN 'Review and fix the vulnerable code pattern' ELSE 'cached' END AS fix_suggestion
FROM b LEFT JOIN ca ON ca.key = b.key""")
def llm_enrich(spark, folder):
    rich = E.enriched(explained(spark, folder))
    fix = F.when(F.col("from_cache"), F.substring_index("fix_suggestion", " ", 1)).otherwise(F.col("fix_suggestion"))
    return rich.select("id", F.round("confidence", 6).alias("confidence"), fix.alias("fix_suggestion"))


@query("enriched_best", f"""
WITH b AS (SELECT d.id, d.detected_at, md5(concat(repeat(code_snippet, 20), ':', vulnerability_type, ':', line_start)) AS key FROM v_detections d JOIN v_feedback f ON d.detection_id = f.detection_id),
ca AS (SELECT key FROM b WHERE detected_at > {V.AS_OF_SQL} - INTERVAL 24 HOUR GROUP BY key)
SELECT b.id, b.id % 3 <> 1 AS marked, b.id % 3 <> 1 AND ca.key IS NOT NULL AS from_cache FROM b LEFT JOIN ca ON ca.key = b.key""")
def enriched_best(spark, folder):
    """Findings with long snippets, explained and enriched, against their plain form: the best of each place.

    A third of the plain forms beats its enriched form, a third is equal, so that the mark decides.
    """
    k = F.col("id") % 3
    f = findings_with_code(spark, folder).withColumns({
        "code_snippet": F.repeat("code_snippet", 20), "confidence": F.when(k == 0, 0.99).when(k == 1, 0.995).otherwise(0.5),
        "ai_explanation": F.lit("rule text"), "fix_suggestion": F.lit("rule fix"), "file_path": F.concat(F.lit("f"), F.col("id").cast("string"))})
    rich = E.enriched(explained(spark, folder, f))
    shown = ["id", "file_path", "line_start", "name", "confidence", "ai_explanation", "analyzer_ord"]
    both = f.withColumn("analyzer_ord", F.lit(0)).select(shown).unionByName(rich.withColumn("analyzer_ord", F.lit(1)).select(shown))
    text = F.col("ai_explanation")
    return C.best_per_place(both).select(
        "id", F.contains(text, F.lit(fixed.ENRICHMENT_MARK)).alias("marked"), F.contains(text, F.lit("cached at ")).alias("from_cache"))


def measuring_client():
    """A stand-in for a model: its answer states how long the prompt is."""
    return lambda text: '```json\n{"detailed_explanation": "%d characters", "fix_recommendation": "asked"}\n```' % len(text)


@query("asked_explanations", f"""
WITH b AS (SELECT d.id, d.line_start, d.severity, f.vulnerability_type AS name, f.code_snippet, md5(concat(code_snippet, ':', vulnerability_type, ':', d.line_start)) AS key
  FROM v_detections d JOIN v_feedback f ON d.detection_id = f.detection_id)
SELECT b.id, b.key AS cache_key, true AS from_cache, 'asked' AS fix_suggestion, (SELECT count(DISTINCT key) FROM b) AS asked FROM b""")
def asked_explanations(spark, folder):
    """Explanations of two runs over one cache: the answers written are those of the first, one per key."""
    path = new_run_folder(spark, "answers")
    f = findings_with_code(spark, folder).withColumn("language", F.lit("python"))
    for _ in range(2):
        explained_now = E.ask_through_cache(f, path, measuring_client, V.as_of())
    written = E.answers(spark, path).agg(F.count("*").alias("n")).scalar()
    return explained_now.select("id", "cache_key", "from_cache", F.col("explanation.fix_recommendation").alias("fix_suggestion"), written.alias("asked"))


def note_lines(code, language, path):
    """A small user analyzer: lines that carry a note."""
    return [
        {"finding_id": f"NOTE-{path}-{n}", "name": "Note left in code", "severity": "info", "confidence": 0.6,
         "line_start": n, "line_end": n, "code_snippet": line.strip()}
        for n, line in enumerate(code.split("\n"), 1) if "note" in line
    ]


@query("custom_analyzer", """
WITH lines AS (SELECT file_path, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n, unnest(string_split(content, chr(10))) AS line FROM v_code_files WHERE language IN ('python', 'php'))
SELECT concat('NOTE-', file_path, '-', n) AS finding_id, file_path, n AS line_start, trim(line) AS code_snippet FROM lines WHERE contains(line, 'note')""")
def custom_analyzer(spark, folder):
    found = Az.run_analyzers(V.code_files(spark, folder), [(Az.python_analyzer(note_lines), ["python", "php"])])
    return found.select("finding_id", "file_path", "line_start", "code_snippet")
