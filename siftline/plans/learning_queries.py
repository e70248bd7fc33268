"""Queries over reviewer feedback, confidence scoring and learned patterns."""
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from .. import views as V
from ..functions import patterns as P
from ..functions import scoring as Sc
from ..functions import text as T
from ..operators import leaders as Lead
from ..operators import learning as Learn
from ..operators import model_findings as M
from ..operators import segments as S
from .registry import query, sql_any, sql_strip, sql_values


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 4) for n in names})


def sql_tokens(col):
    """Same steps in the same order as the tokeniser."""
    step = f"regexp_replace({col}, '#[^\\n]*', '', 'g')"
    step = f"regexp_replace({step}, '//[^\\n]*', '', 'g')"
    step = f"regexp_replace({step}, '\"[^\"]*\"', 'STRING', 'g')"
    step = f"regexp_replace({step}, '''[^'']*''', 'STRING', 'g')"
    return f"regexp_extract_all(lower({step}), '[\\p{{L}}\\p{{N}}_]+')"


def sql_normalised(col):
    return f"array_to_string(list_filter(list_transform(string_split({col}, chr(10)), lambda l: {sql_strip('l')}), lambda l: l <> ''), chr(10))"


def sql_hash(col):
    return f"md5({sql_normalised(col)})"


@query("type_accuracy", """
SELECT vulnerability_type, round(avg(cast(was_correct AS int)), 4) AS accuracy, count(*) AS samples FROM v_feedback GROUP BY 1""")
def type_accuracy(spark, folder):
    return rounded(Learn.type_accuracy(V.feedback(spark, folder)), "accuracy")


ADJUST_CTE = """acc AS (SELECT vulnerability_type, count(*) AS total, count(*) FILTER (was_correct) / count(*) AS accuracy FROM v_feedback GROUP BY 1),
adj AS (SELECT vulnerability_type, total, accuracy, total >= 5 AS enough,
  CASE WHEN total < 5 THEN 1.0 WHEN accuracy < 0.5 THEN accuracy + 0.5 ELSE (accuracy - 0.5) * 0.5 + 1.0 END AS adjustment FROM acc)"""


@query("confidence_adjustments", f"WITH {ADJUST_CTE} SELECT vulnerability_type, round(adjustment, 4) AS adjustment, round(accuracy, 4) AS accuracy, total, enough FROM adj")
def confidence_adjustments(spark, folder):
    return rounded(Learn.confidence_adjustments(V.feedback(spark, folder)), "adjustment", "accuracy")


METHOD_CTE = """meth AS (SELECT detection_method, count(*) AS samples, count(*) >= 10 AS enough, count(*) FILTER (was_correct) / count(*) AS measured,
CASE WHEN count(*) < 10 THEN 0.75 ELSE count(*) FILTER (was_correct) / count(*) END AS accuracy FROM v_feedback GROUP BY 1)"""


@query("method_accuracy", f"WITH {METHOD_CTE} SELECT detection_method, round(accuracy, 4) AS accuracy, round(measured, 4) AS measured, samples, enough FROM meth")
def method_accuracy(spark, folder):
    return rounded(Learn.method_accuracy(V.feedback(spark, folder)), "accuracy", "measured")


@query("ml_performance", f"""
WITH {ADJUST_CTE}, t AS (SELECT count(*) AS n, count(*) FILTER (was_correct) AS tp FROM v_feedback)
SELECT vulnerability_type, enough, round(least(adjustment * 0.7, 0.95), 4) AS type_accuracy, (SELECT count(*) FROM v_scans) AS total_scans,
  (SELECT count(*) FROM v_detections) AS total_detections, tp AS true_positives, n - tp AS false_positives,
  round(tp / greatest(n, 1), 4) AS accuracy FROM adj, t""")
def ml_performance(spark, folder):
    report = Learn.ml_performance(V.scans(spark, folder), V.detections(spark, folder), V.feedback(spark, folder))
    return rounded(report, "type_accuracy", "accuracy")


@query("accuracy_by_batch", """
SELECT cast((n - 1) // 5 AS bigint) AS batch, round(avg(cast(was_correct AS int)), 4) AS accuracy, count(*) AS records
FROM (SELECT was_correct, row_number() OVER (ORDER BY seq) AS n FROM v_feedback) GROUP BY 1""")
def accuracy_by_batch(spark, folder):
    return rounded(Learn.accuracy_by_batch(V.feedback(spark, folder)), "accuracy")


@query("running_accuracy", """
SELECT seq, round(coalesce(avg(cast(was_correct AS int)) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS accuracy_before,
  round(avg(cast(was_correct AS int)) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING), 4) AS accuracy_after FROM v_feedback""")
def running_accuracy(spark, folder):
    return rounded(Learn.running_accuracy(V.feedback(spark, folder)), "accuracy_before", "accuracy_after")


@query("time_decay", f"""
WITH t AS (SELECT vulnerability_type, detection_method, max(feedback_ts) - INTERVAL 1 DAY * (length(detection_method) * 7) AS latest FROM v_feedback GROUP BY 1, 2),
  d AS (SELECT *, cast(floor((epoch({V.AS_OF_SQL}) - epoch(latest)) / 86400) AS bigint) AS days FROM t)
SELECT vulnerability_type, detection_method, latest, CASE WHEN days < 7 THEN 1.0 WHEN days < 30 THEN 0.95 WHEN days < 90 THEN 0.9 ELSE 0.8 END AS decay FROM d""")
def time_decay(spark, folder):
    groups = V.feedback(spark, folder).groupBy("vulnerability_type", "detection_method").agg(F.max("feedback_ts").alias("last"))
    shifted = groups.withColumn("latest", F.expr("last - make_dt_interval(length(detection_method) * 7)"))
    return shifted.select("vulnerability_type", "detection_method", "latest", Learn.time_decay(F.col("latest"), V.as_of()).alias("decay"))


@query("method_tags", """
SELECT id, CASE WHEN a = '' THEN 'unknown' ELSE a END AS scorer_methods, CASE WHEN b = '' THEN 'unknown' ELSE b END AS learning_methods FROM (
  SELECT id, concat_ws(',', CASE WHEN contains(detector_id,'PATTERN') OR contains(detector_id,'PARSE') THEN 'pattern' END,
    CASE WHEN contains(detector_id,'AST') OR contains(detector_id,'PARSE') THEN 'ast' END, CASE WHEN contains(detector_id,'AI-') THEN 'codebert' END,
    CASE WHEN contains(detector_id,'GNN') THEN 'gnn' END, CASE WHEN contains(detector_id,'HYBRID') THEN 'hybrid' END) AS a,
  concat_ws(',', CASE WHEN contains(detector_id,'PATTERN') THEN 'pattern' END,
    CASE WHEN contains(detector_id,'AST') OR contains(detector_id,'PARSE') THEN 'ast' END, CASE WHEN contains(detector_id,'AI-') THEN 'ai' END,
    CASE WHEN contains(detector_id,'GNN') THEN 'gnn' END, CASE WHEN contains(detector_id,'HYBRID') THEN 'hybrid' END) AS b FROM v_detections)""")
def method_tags(spark, folder):
    d = V.detections(spark, folder)
    scored = Sc.method_scores(F.col("detector_id"), F.col("confidence_score"))
    return d.select("id", F.array_join(F.transform(scored, lambda m: m["method"]), ",").alias("scorer_methods"),
                    F.array_join(Sc.learning_methods(F.col("detector_id")), ",").alias("learning_methods"))


def scored_findings(spark, folder):
    """Findings with their snippet, context and two opinions on each."""
    f = V.feedback(spark, folder).select("detection_id", "vulnerability_type", "code_snippet", "detection_method", "seq", "was_correct")
    d = V.detections(spark, folder).join(f, "detection_id")
    code = F.col("code_snippet")
    second = F.array(F.struct(F.col("detection_method").alias("method"), (F.col("line_start") / F.lit(200.0)).alias("score")))
    return d.select(
        "id", "detector_id", "vulnerability_type", "code_snippet", F.col("confidence_score").alias("confidence"),
        F.when(F.col("line_start") % 4 == 0, F.concat(F.lit("src/tests/"), "file_path")).otherwise(F.col("file_path")).alias("file_path"),
        (F.col("line_start") % 15).alias("complexity"),
        F.contains(code, F.lit("# ")).alias("in_comment"),
        F.concat(Sc.method_scores(F.col("detector_id"), F.col("confidence_score")), second).alias("methods"),
        *[c.alias(n) for n, c in S.code_context(code).items() if n in ("has_user_input", "has_validation")],
    )


def with_factors(spark, folder):
    history = Learn.type_accuracy(V.feedback(spark, folder)).select("vulnerability_type", "accuracy")
    f = scored_findings(spark, folder).join(history, "vulnerability_type", "left")
    return f.withColumns({
        "base": Sc.base_confidence(F.col("methods")),
        "context": Sc.context_score(F.col("file_path"), F.col("in_comment"), F.col("has_user_input"), F.col("has_validation"), F.col("code_snippet")),
        "historical": F.coalesce("accuracy", F.lit(fixed.DEFAULT_TYPE_ACCURACY)),
        "complexity_factor": Sc.complexity_score(F.col("complexity")),
        "validation": Sc.agreement(F.col("methods")),
    })


def _overall():
    return Sc.overall_confidence({
        "base": F.col("base"), "context": F.col("context"), "historical": F.col("historical"),
        "complexity": F.col("complexity_factor"), "validation": F.col("validation")})


SCORED_CTE = f"""sf AS (SELECT d.id, d.detector_id, f.vulnerability_type, f.code_snippet, d.confidence_score AS confidence, f.detection_method,
  CASE WHEN line_start % 4 = 0 THEN concat('src/tests/', file_path) ELSE file_path END AS file_path, line_start % 15 AS complexity, line_start,
  contains(f.code_snippet, '# ') AS in_comment, {sql_any('lower(f.code_snippet)', fixed.CONTEXT_INPUT_WORDS)} AS has_user_input,
  {sql_any('f.code_snippet', fixed.CONTEXT_VALIDATION_WORDS)} AS has_validation FROM v_detections d JOIN v_feedback f ON d.detection_id = f.detection_id),
m AS (SELECT id, 'pattern' AS method, confidence AS score FROM sf WHERE contains(detector_id,'PATTERN') OR contains(detector_id,'PARSE')
  UNION ALL SELECT id, 'ast', confidence FROM sf WHERE contains(detector_id,'AST') OR contains(detector_id,'PARSE')
  UNION ALL SELECT id, 'codebert', confidence FROM sf WHERE contains(detector_id,'AI-') UNION ALL SELECT id, 'gnn', confidence FROM sf WHERE contains(detector_id,'GNN')
  UNION ALL SELECT id, 'hybrid', confidence FROM sf WHERE contains(detector_id,'HYBRID') UNION ALL SELECT id, 'unknown', confidence FROM sf WHERE contains(detector_id,'OTHER')
  UNION ALL SELECT id, detection_method, line_start / 200.0 FROM sf),
{sql_values("mw", ["method", "w"], list(fixed.METHOD_WEIGHTS.items()))},
ma AS (SELECT id, sum(score * coalesce(w, 0.5)) / sum(coalesce(w, 0.5)) AS base, count(*) AS n, var_pop(score) AS v,
  count(*) FILTER (m.method IN ('codebert','gnn','hybrid')) AS n_ai, bool_and(score > 0.8) FILTER (m.method IN ('codebert','gnn','hybrid')) AS strong
  FROM m LEFT JOIN mw ON mw.method = m.method GROUP BY id),
hist AS (SELECT vulnerability_type, avg(cast(was_correct AS int)) AS accuracy FROM v_feedback GROUP BY 1),
fac AS (SELECT sf.*, base, n_ai, strong, greatest(0, least(1, 1.0::DOUBLE
    - CASE WHEN {sql_any('lower(file_path)', fixed.TEST_PATH_MARKS)} THEN 0.3 ELSE 0 END - CASE WHEN in_comment THEN 0.5 ELSE 0 END
    + CASE WHEN has_user_input THEN 0.2 ELSE 0 END - CASE WHEN has_validation THEN 0.3 ELSE 0 END
    - CASE WHEN {sql_any('lower(code_snippet)', fixed.SECURITY_FUNCTION_WORDS)} THEN 0.2 ELSE 0 END)) AS context,
  coalesce(hist.accuracy, 0.75) AS historical, CASE WHEN complexity > 10 THEN 0.7 WHEN complexity > 5 THEN 0.85 ELSE 1 END AS complexity_factor,
  CASE WHEN n < 2 THEN 0.5 WHEN v < 0.05 THEN 0.95 WHEN v < 0.1 THEN 0.8 WHEN v < 0.2 THEN 0.6 ELSE 0.4 END AS validation
  FROM sf JOIN ma ON ma.id = sf.id LEFT JOIN hist ON hist.vulnerability_type = sf.vulnerability_type)"""


@query("confidence_score", f"""
WITH {SCORED_CTE} SELECT id, round(base, 9) AS base, round(context, 9) AS context, round(historical, 9) AS historical, round(complexity_factor, 9) AS complexity_factor,
  round(validation, 9) AS validation, round(greatest(0, least(1, base * 0.4 + context * 0.2 + historical * 0.15 + complexity_factor * 0.1 + validation * 0.15)), 9) AS overall FROM fac""")
def confidence_score(spark, folder):
    f = with_factors(spark, folder).withColumn("overall", _overall())
    shown = ["base", "context", "historical", "complexity_factor", "validation", "overall"]
    return f.select("id", *[F.round(c, 9).alias(c) for c in shown])


@query("context_score", f"WITH {SCORED_CTE} SELECT id, round(context, 4) AS context FROM fac")
def context_score(spark, folder):
    return rounded(with_factors(spark, folder).select("id", "context"), "context")


@query("reliability", f"""
WITH {SCORED_CTE} SELECT id, CASE WHEN n_ai >= 2 AND strong THEN 'high' WHEN validation > 0.7 AND base > 0.7 THEN 'high'
  WHEN base > 0.5 THEN 'medium' ELSE 'low' END AS reliability FROM fac""")
def reliability(spark, folder):
    return with_factors(spark, folder).select(
        "id", Sc.reliability(F.col("methods"), F.col("base"), F.col("validation")).alias("reliability"))


@query("confidence_explanations")
def confidence_explanations(spark, folder):
    f = with_factors(spark, folder).withColumn("overall", _overall())
    factors = {"base_detection": F.col("base"), "context": F.col("context"), "historical": F.col("historical"),
               "complexity": F.col("complexity_factor"), "validation": F.col("validation")}
    return f.select("id", M.confidence_explanation(F.col("vulnerability_type"), F.col("overall"), F.col("methods"), factors).alias("explanation"))


TEXT_SOURCES = "texts AS (SELECT 'file' AS kind, file_id AS id, content AS text FROM v_code_files UNION ALL SELECT 'document', doc_id, text FROM documents)"


def texts(spark, folder):
    from .scan_queries import texts as both

    return both(spark, folder)


@query("tokenise_code", f"WITH {TEXT_SOURCES} SELECT kind, id, array_to_string({sql_tokens('text')}, ' ') AS tokens FROM texts")
def tokenise_code(spark, folder):
    return texts(spark, folder).select("kind", "id", F.array_join(T.code_tokens("text"), " ").alias("tokens"))


@query("structure_hash", f"WITH {TEXT_SOURCES} SELECT kind, id, {sql_hash('text')} AS structure_hash FROM texts")
def structure_hash(spark, folder):
    return texts(spark, folder).select("kind", "id", T.structure_hash("text").alias("structure_hash"))


@query("pattern_features", f"""
WITH {TEXT_SOURCES} SELECT kind, id, array_to_string({sql_tokens('text')}, ' ') AS tokens, length(text) AS length,
  length(text) - length(replace(text, chr(10), '')) + 1 AS line_count, {sql_any('lower(text)', fixed.FEATURE_INPUT_WORDS)} AS has_user_input,
  {sql_any('text', fixed.FEATURE_VALIDATION_WORDS)} AS has_validation, {sql_hash('text')} AS structure_hash FROM texts""")
def pattern_features(spark, folder):
    described = texts(spark, folder).select("kind", "id", P.features(F.col("text")).alias("f")).select("kind", "id", "f.*")
    return described.withColumn("tokens", F.array_join("tokens", " "))


SNIP_CTE = f"""sn AS (SELECT vulnerability_type, code_snippet, min(seq) AS seq FROM v_feedback GROUP BY 1, 2),
ft AS (SELECT *, {sql_tokens('code_snippet')} AS tokens, list_distinct({sql_tokens('code_snippet')}) AS tset, {sql_hash('code_snippet')} AS h,
  {sql_any('lower(code_snippet)', fixed.FEATURE_INPUT_WORDS)} AS ui, {sql_any('code_snippet', fixed.FEATURE_VALIDATION_WORDS)} AS va FROM sn)"""
SQL_JACCARD = "len(list_intersect(a.tset, b.tset)) / len(list_distinct(list_concat(a.tset, b.tset)))"
SQL_SIMILARITY = f"""(CASE WHEN len(a.tset) > 0 AND len(b.tset) > 0 THEN {SQL_JACCARD} ELSE 0 END + CASE WHEN a.h = b.h THEN 1 ELSE 0 END
  + CASE WHEN a.ui = b.ui THEN 0.5 ELSE 0 END + CASE WHEN a.va = b.va THEN 0.5 ELSE 0 END) / (CASE WHEN len(a.tset) > 0 AND len(b.tset) > 0 THEN 3 ELSE 2 END)"""


def _neighbours(spark, folder):
    """Each record's snippet beside the one that arrived just before it."""
    from ..operators.ordered import previous_values

    f = V.feedback(spark, folder).select("seq", "code_snippet")
    return previous_values(f, [], "seq", {"before": "code_snippet"}).filter("before IS NOT NULL")


NEXT_CTE = f"""nx AS (SELECT seq, code_snippet AS x, lag(code_snippet) OVER (ORDER BY seq) AS y FROM v_feedback),
px AS (SELECT seq, list_distinct({sql_tokens('x')}) AS tset, {sql_hash('x')} AS h, {sql_any('lower(x)', fixed.FEATURE_INPUT_WORDS)} AS ui, {sql_any('x', fixed.FEATURE_VALIDATION_WORDS)} AS va FROM nx WHERE y IS NOT NULL),
py AS (SELECT seq, list_distinct({sql_tokens('y')}) AS tset, {sql_hash('y')} AS h, {sql_any('lower(y)', fixed.FEATURE_INPUT_WORDS)} AS ui, {sql_any('y', fixed.FEATURE_VALIDATION_WORDS)} AS va FROM nx WHERE y IS NOT NULL)"""


@query("token_jaccard", f"""
WITH {NEXT_CTE} SELECT a.seq, CASE WHEN len(a.tset) > 0 AND len(b.tset) > 0 THEN round({SQL_JACCARD}, 4) END AS jaccard FROM px a JOIN py b ON a.seq = b.seq""")
def token_jaccard(spark, folder):
    n = _neighbours(spark, folder)
    return n.select("seq", F.round(P.jaccard(T.code_tokens("code_snippet"), T.code_tokens("before")), 4).alias("jaccard"))


@query("pattern_similarity", f"WITH {NEXT_CTE} SELECT a.seq, round({SQL_SIMILARITY}, 4) AS similarity FROM px a JOIN py b ON a.seq = b.seq")
def pattern_similarity(spark, folder):
    n = _neighbours(spark, folder).select("seq", P.features(F.col("code_snippet")).alias("a"), P.features(F.col("before")).alias("b"))
    return n.select("seq", F.round(P.similarity(F.col("a"), F.col("b")), 4).alias("similarity"))


@query("learn_patterns_hash", f"""
SELECT vulnerability_type, {sql_hash('code_snippet')} AS structure_hash, count(*) AS confirmations, min(seq) AS first_seen, max(seq) AS last_seen,
  arg_min(code_snippet, seq) AS code_example FROM v_feedback WHERE was_correct GROUP BY 1, 2""")
def learn_patterns_hash(spark, folder):
    return Learn.patterns_by_structure(V.feedback(spark, folder))


# the sequential meaning: distinct snippets in arrival order, each joining the first leader it is similar to
LEADERS_CTE = f"""described AS (SELECT vulnerability_type, seq, code_snippet, {sql_hash('code_snippet')} AS h, list_sort(list_distinct({sql_tokens('code_snippet')})) AS tset
  FROM v_feedback WHERE was_correct),
snippets AS (SELECT vulnerability_type, h, tset, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS arrivals, arg_min(code_snippet, seq) AS code_example
  FROM described GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY vulnerability_type ORDER BY first_seq) AS n FROM snippets),
alike AS (SELECT b.vulnerability_type, b.n, coalesce(list(a.n ORDER BY a.n) FILTER (a.n IS NOT NULL), []) AS earlier FROM placed b LEFT JOIN placed a
  ON a.vulnerability_type = b.vulnerability_type AND a.n < b.n AND (a.h = b.h OR (len(a.tset) > 0 AND len(b.tset) > 0
    AND len(list_intersect(a.tset, b.tset)) / len(list_distinct(list_concat(a.tset, b.tset))) > 0.7)) GROUP BY ALL),
walk AS (SELECT DISTINCT vulnerability_type, 0::BIGINT AS n, []::BIGINT[] AS leaders FROM placed
  UNION ALL SELECT w.vulnerability_type, alike.n, CASE WHEN list_has_any(w.leaders, alike.earlier) THEN w.leaders ELSE list_append(w.leaders, alike.n) END
  FROM walk w JOIN alike ON alike.vulnerability_type = w.vulnerability_type AND alike.n = w.n + 1),
final AS (SELECT vulnerability_type, leaders FROM walk QUALIFY n = max(n) OVER (PARTITION BY vulnerability_type)),
member AS (SELECT alike.vulnerability_type, alike.n, coalesce(list_min(list_intersect(leaders, earlier)), alike.n) AS leader
  FROM alike JOIN final ON final.vulnerability_type = alike.vulnerability_type),
led AS (SELECT m.vulnerability_type, m.leader, cast(sum(p.arrivals) AS bigint) AS confirmations, max(p.last_seq) AS last_seen
  FROM member m JOIN placed p ON p.vulnerability_type = m.vulnerability_type AND p.n = m.n GROUP BY 1, 2),
learned AS (SELECT p.vulnerability_type, p.h AS structure_hash, p.code_example, 0.1::DOUBLE AS confidence_boost, led.confirmations, p.first_seq AS first_seen, led.last_seen
  FROM led JOIN placed p ON p.vulnerability_type = led.vulnerability_type AND p.n = led.leader)"""


@query("learn_patterns", f"WITH RECURSIVE {LEADERS_CTE} SELECT * FROM learned")
def learn_patterns(spark, folder):
    return Lead.learn_patterns(V.feedback(spark, folder))


@query("learned_and_avoided", f"""
WITH RECURSIVE {LEADERS_CTE} SELECT * FROM learned
UNION ALL SELECT concat('{fixed.FALSE_POSITIVE_PREFIX}', vulnerability_type), {sql_hash('code_snippet')}, code_snippet, -0.2::DOUBLE, count(*), min(seq), max(seq)
FROM v_feedback WHERE NOT was_correct GROUP BY vulnerability_type, code_snippet""")
def learned_and_avoided(spark, folder):
    return Lead.learned_and_avoided(V.feedback(spark, folder))


@query("learning_report", f"""
WITH p AS (SELECT count(*) AS n FROM (SELECT DISTINCT vulnerability_type, {sql_hash('code_snippet')} FROM v_feedback WHERE was_correct)),
  e AS (SELECT avg(cast(was_correct AS int)) AS a FROM (SELECT was_correct FROM v_feedback ORDER BY seq LIMIT 10)),
  r AS (SELECT avg(cast(was_correct AS int)) AS a FROM (SELECT was_correct FROM v_feedback ORDER BY seq DESC LIMIT 10))
SELECT count(*) AS total_feedback, count(*) FILTER (was_correct) AS true_positives, count(*) FILTER (NOT was_correct) AS false_positives,
  round(CASE WHEN count(*) >= 20 THEN any_value(r.a) - any_value(e.a) ELSE 0 END, 4) AS accuracy_improvement,
  round(any_value(r.a) - any_value(e.a), 4) AS measured_gain, count(*) >= 20 AS enough, any_value(p.n) AS patterns_learned FROM v_feedback, p, e, r""")
def learning_report(spark, folder):
    f = V.feedback(spark, folder)
    return rounded(Learn.learning_report(f, Learn.patterns_by_structure(f)), "accuracy_improvement", "measured_gain")


def structural_patterns(spark, folder):
    f = V.feedback(spark, folder)
    return Learn.patterns_by_structure(f).withColumn("confidence_boost", F.lit(0.1))


STRUCT_CTE = f"""{SNIP_CTE}, lp AS (SELECT vulnerability_type, {sql_hash('code_snippet')} AS h, count(*) AS confirmations, min(seq) AS first_seen, arg_min(code_snippet, seq) AS code_example
  FROM v_feedback WHERE was_correct GROUP BY 1, 2),
lpf AS (SELECT lp.*, list_distinct({sql_tokens('code_example')}) AS tset, {sql_any('lower(code_example)', fixed.FEATURE_INPUT_WORDS)} AS ui,
  {sql_any('code_example', fixed.FEATURE_VALIDATION_WORDS)} AS va FROM lp),
boost AS (SELECT a.vulnerability_type, a.code_snippet, max(0.1 * {SQL_SIMILARITY} * least(b.confirmations / 10, 2)) AS boost FROM ft a JOIN lpf b ON a.vulnerability_type = b.vulnerability_type
  WHERE {SQL_SIMILARITY} > 0.8 GROUP BY 1, 2),
fp AS (SELECT DISTINCT f.vulnerability_type, f.code_snippet FROM v_feedback f WHERE NOT was_correct),
fpf AS (SELECT *, list_distinct({sql_tokens('code_snippet')}) AS tset, {sql_hash('code_snippet')} AS h, {sql_any('lower(code_snippet)', fixed.FEATURE_INPUT_WORDS)} AS ui,
  {sql_any('code_snippet', fixed.FEATURE_VALIDATION_WORDS)} AS va FROM fp),
penalty AS (SELECT a.vulnerability_type, a.code_snippet, min(-0.2 * {SQL_SIMILARITY}) AS penalty FROM ft a JOIN fpf b ON a.vulnerability_type = b.vulnerability_type
  WHERE {SQL_SIMILARITY} > 0.85 GROUP BY 1, 2)"""


@query("learned_boost", f"WITH {STRUCT_CTE} SELECT vulnerability_type, code_snippet, round(boost, 4) AS boost FROM boost")
def learned_boost(spark, folder):
    return rounded(Learn.learned_boost(V.feedback(spark, folder), structural_patterns(spark, folder)), "boost")


@query("fp_penalty", f"WITH {STRUCT_CTE} SELECT vulnerability_type, code_snippet, round(penalty, 4) AS penalty FROM penalty")
def fp_penalty(spark, folder):
    f = V.feedback(spark, folder)
    return rounded(Learn.false_positive_penalty(f, Learn.false_positive_patterns(f)), "penalty")


@query("adjust_confidence", f"""
WITH {STRUCT_CTE}, {ADJUST_CTE}, {METHOD_CTE}, dd AS (SELECT cast(floor((epoch({V.AS_OF_SQL}) - epoch(max(feedback_ts))) / 86400) AS bigint) AS days FROM v_feedback),
lm AS (SELECT id, unnest(CASE WHEN contains(detector_id,'PATTERN') THEN ['pattern'] WHEN contains(detector_id,'PARSE') OR contains(detector_id,'AST') THEN ['ast'] WHEN contains(detector_id,'AI-') THEN ['ai']
  WHEN contains(detector_id,'GNN') THEN ['gnn'] WHEN contains(detector_id,'HYBRID') THEN ['hybrid'] ELSE ['unknown'] END) AS method FROM v_detections),
wk AS (SELECT lm.id, count(*) FILTER (meth.accuracy < 0.7) AS n FROM lm LEFT JOIN meth ON meth.detection_method = lm.method GROUP BY 1),
j AS (SELECT d.id, d.confidence_score AS c, greatest(0.1, least(0.99, (d.confidence_score * coalesce(adj.adjustment, 1) + coalesce(boost, 0) + coalesce(penalty, 0)) * power(0.9, wk.n)
    * CASE WHEN days < 7 THEN 1 WHEN days < 30 THEN 0.95 WHEN days < 90 THEN 0.9 ELSE 0.8 END)) AS a
  FROM v_detections d JOIN v_feedback f ON f.detection_id = d.detection_id LEFT JOIN adj ON adj.vulnerability_type = f.vulnerability_type
  LEFT JOIN boost b ON b.vulnerability_type = f.vulnerability_type AND b.code_snippet = f.code_snippet LEFT JOIN penalty p ON p.vulnerability_type = f.vulnerability_type AND p.code_snippet = f.code_snippet
  JOIN wk ON wk.id = d.id, dd)
SELECT id, round(a, 4) AS adjusted_confidence, CASE WHEN a > c THEN 'Boosted due to similarity with confirmed patterns'
  WHEN a < c THEN 'Reduced due to similarity with false positive patterns' ELSE 'No adjustment needed' END AS adjustment_reason FROM j""")
def adjust_confidence(spark, folder):
    findings = scored_findings(spark, folder).select("id", "detector_id", "vulnerability_type", "code_snippet", "confidence")
    done = Learn.adjust_confidence(findings, V.feedback(spark, folder), structural_patterns(spark, folder), V.as_of())
    return rounded(done.select("id", "adjusted_confidence", "adjustment_reason"), "adjusted_confidence")


SUGGEST_CTE = f"""lp AS (SELECT vulnerability_type, {sql_hash('code_snippet')} AS h, count(*) AS confirmations, min(seq) AS first_seen, arg_min(code_snippet, seq) AS code_example
  FROM v_feedback WHERE was_correct GROUP BY 1, 2), sg AS (SELECT * FROM lp WHERE confirmations >= 3 ORDER BY confirmations DESC, vulnerability_type, first_seen LIMIT 10)"""


@query("pattern_suggestions", f"WITH {SUGGEST_CTE} SELECT vulnerability_type, code_example, confirmations, first_seen FROM sg")
def pattern_suggestions(spark, folder):
    return Learn.pattern_suggestions(structural_patterns(spark, folder)).select("vulnerability_type", "code_example", "confirmations", "first_seen")


@query("approve_pattern", f"""
WITH {SUGGEST_CTE}, pick AS (SELECT * FROM sg ORDER BY confirmations DESC, vulnerability_type, first_seen LIMIT 1 OFFSET 2)
SELECT concat('LEARNED-', md5(concat(vulnerability_type, '|', code_example))) AS rule_id, concat('Learned ', vulnerability_type, ' Pattern') AS name,
  concat('Pattern learned from ', confirmations, ' confirmed detections') AS description, 'high' AS severity, 'python,javascript' AS languages,
  code_example AS python_regex, round(0.7 + 0.1, 4) AS threshold FROM pick""")
def approve_pattern(spark, folder):
    rule = Learn.approve_suggestion(Learn.pattern_suggestions(structural_patterns(spark, folder)), 2)
    return rule.select("rule_id", "name", "description", "severity", F.array_join("languages", ",").alias("languages"),
                       F.element_at(F.element_at("detection_patterns", F.lit("python")), 1).alias("python_regex"),
                       F.round("threshold", 4).alias("threshold"))


@query("feedback_features", f"""
SELECT seq, length(code_snippet) AS length, length(code_snippet) - length(replace(code_snippet, chr(10), '')) AS newlines,
  {', '.join(f"cast(contains(code_snippet, '{w}') AS int) AS has_{w.lower()}" for w in fixed.CLASSIFIER_WORDS)},
  original_confidence, cast(was_correct AS int) AS label FROM v_feedback""")
def feedback_features(spark, folder):
    return Learn.classifier_features(V.feedback(spark, folder))


@query("feedback_rf")
def feedback_rf(spark, folder):
    """Records by label and prediction; none while there is too little feedback for a model."""
    trained = Learn.train_feedback_classifier(V.feedback(spark, folder))
    from pyspark.ml.feature import VectorAssembler

    rows = Learn.classifier_features(V.feedback(spark, folder))
    if trained is None:
        return spark.createDataFrame([], "label int, prediction int, records long, cv_accuracy double")
    model, accuracy = trained
    inputs = [c for c in rows.columns if c not in ("seq", "label")]
    scored = model.transform(VectorAssembler(inputCols=inputs, outputCol="features").transform(rows))
    return scored.groupBy("label", F.col("prediction").cast("int").alias("prediction")).agg(
        F.count("*").alias("records")).withColumn("cv_accuracy", F.lit(round(accuracy, 4)))
