"""Queries over embeddings: similarity, evolution, clusters and anomalies."""
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from .. import views as V
from ..functions import text as T
from ..functions.vectors import cosine
from ..operators import anomaly as An
from ..operators import clusters as Cl
from ..operators import similarity as Sim
from ..session import new_run_folder
from ..sources import stored
from .graph_queries import NODES_CTE
from .registry import SQL_BLANK, query, sql_any, sql_strip
from .scan_queries import LINES_CTE

VEC_CTE = """pv AS (SELECT cast(substr(pattern_id, 3) AS bigint) AS id, type_id, part_role, embedding::DOUBLE[] AS e FROM v_patterns_vec)"""
BASE = "CASE WHEN {0} % 10 < 3 THEN {0} ELSE {0} - {0} % 10 + {0} % 3 END"
COS = "CASE WHEN list_dot_product(q.e, q.e) = 0 OR list_dot_product(k.e, k.e) = 0 THEN 0 ELSE list_cosine_similarity(q.e, k.e) END"


def base_of(column):
    """The known vector a vector was spliced from; known ones are their own."""
    return F.expr(BASE.format(column))


def vectors(spark, folder):
    v = V.pattern_vectors(spark, folder)
    return v.select(F.substring("pattern_id", 3, 20).cast("long").alias("id"), F.col("type_id").cast("long").alias("ref_group"),
                    "part_role", "embedding")


def role(spark, folder, name):
    return vectors(spark, folder).filter(F.col("part_role") == name).drop("part_role")


@query("cosine_pairs", f"""
WITH {VEC_CTE} SELECT q.id, round({COS}, 4) AS similarity FROM pv q JOIN pv k ON k.id = {BASE.format('q.id')}""")
def cosine_pairs(spark, folder):
    """Every vector with the known one it was spliced from."""
    all_rows = vectors(spark, folder).select("id", "embedding", base_of("id").alias("k"))
    known = role(spark, folder, "known").select(F.col("id").alias("k"), F.col("embedding").alias("base"))
    return all_rows.join(known, "k").select("id", F.round(cosine("embedding", "base"), 4).alias("similarity"))


@query("similar_topk", f"""
WITH {VEC_CTE}, s AS (SELECT q.id AS query_id, k.id AS ref_id, {COS} AS s FROM pv q JOIN pv k ON q.part_role = 'query' AND k.part_role = 'known')
SELECT query_id, ref_id, round(s, 4) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ref_id) <= 5""")
def similar_topk(spark, folder):
    found = Sim.most_similar(role(spark, folder, "query"), role(spark, folder, "known"))
    return found.select("query_id", "ref_id", F.round("score", 4).alias("similarity"))


EX_CTE = f"""{VEC_CTE}, s AS (SELECT q.id AS query_id, k.id AS ref_id, k.type_id AS ref_group, {COS} AS s FROM pv q JOIN pv k ON q.part_role = 'query' AND k.part_role = 'known'),
top AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ref_id) <= 3), per AS (SELECT query_id, ref_group, max(s) AS best, avg(s) AS mean FROM s GROUP BY 1, 2),
f AS (SELECT top.*, best, mean, least(s + CASE WHEN best > 0.9 THEN 0.2 WHEN best > 0.8 THEN 0.15 WHEN best > 0.7 THEN 0.1 WHEN best > 0.6 THEN 0.05 ELSE 0 END, 0.95) AS confidence
  FROM top JOIN per ON per.query_id = top.query_id AND per.ref_group = top.ref_group WHERE s > 0.75)"""


@query("exemplar_findings", f"""
WITH {EX_CTE} SELECT query_id, ref_id, cast(ref_group AS bigint) AS ref_group, round(s, 4) AS similarity, round(best, 4) AS best, round(mean, 4) AS mean, round(confidence, 4) AS confidence,
  best > 0.7 AS similar_to_known FROM f WHERE confidence > 0.7""")
def exemplar_findings(spark, folder):
    found = Sim.exemplar_findings(role(spark, folder, "query"), role(spark, folder, "known"))
    return found.withColumns({c: F.round(c, 4) for c in ("similarity", "best", "mean", "confidence")})


@query("secret_similarity", f"""
WITH {VEC_CTE}, s AS (SELECT q.id AS query_id, k.id AS ref_id, {COS} AS s FROM pv q JOIN pv k ON q.part_role = 'query' AND k.part_role = 'known' AND k.type_id = 7)
SELECT query_id, min(ref_id) AS ref_id, round(arg_min(s, ref_id), 4) AS confidence FROM s WHERE s > 0.7 GROUP BY 1""")
def secret_similarity(spark, folder):
    secrets = role(spark, folder, "known").filter(F.col("ref_group") == 7)
    return Sim.first_match(role(spark, folder, "query"), secrets).withColumn("confidence", F.round("confidence", 4))


@query("pattern_evolution", f"""
WITH {VEC_CTE}, near AS (SELECT q.id AS query_id, k.id AS ref_id, {COS} AS s FROM pv q JOIN pv k ON q.part_role = 'query' AND k.part_role = 'known'),
seen AS (SELECT DISTINCT q.id AS query_id, {BASE.format('k.id')} AS ref_id FROM pv q JOIN pv k ON q.part_role = 'query' AND k.part_role = 'mutation' WHERE {COS} > 0.95),
cnt AS (SELECT {BASE.format('id')} AS ref_id, count(*) AS n FROM pv WHERE part_role = 'mutation' GROUP BY 1)
SELECT near.query_id, concat('EVOLUTION-P-', near.ref_id, '-', coalesce(n, 0)) AS evolution_id, round(s, 4) AS similarity, -0.6 AS anomaly_score, 0.7 AS confidence
FROM near LEFT JOIN cnt ON cnt.ref_id = near.ref_id WHERE s > 0.6 AND s < 0.9 AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.query_id = near.query_id AND seen.ref_id = near.ref_id)""")
def pattern_evolution(spark, folder):
    return evolved(spark, folder).select(
        "query_id", F.concat(F.lit("EVOLUTION-P-"), F.col("ref_id").cast("string"), F.lit("-"), F.col("recorded").cast("string")).alias("evolution_id"),
        F.round("similarity", 4).alias("similarity"), "anomaly_score", "confidence")


def evolved(spark, folder):
    mutations = role(spark, folder, "mutation").withColumn("ref_group", base_of("id"))
    return Sim.pattern_evolution(role(spark, folder, "query"), role(spark, folder, "known"), mutations)


@query("dbscan_clusters", f"""
WITH RECURSIVE {VEC_CTE}, e AS (SELECT a.id AS a, b.id AS b FROM pv a JOIN pv b ON a.id <> b.id AND list_distance(a.e, b.e) <= 0.3),
reach AS (SELECT a AS id, a AS r FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.id),
root AS (SELECT id, min(r) AS root FROM reach GROUP BY id)
SELECT pv.id, coalesce(cast(dense_rank() OVER (ORDER BY root NULLS LAST) - 1 AS bigint) + CASE WHEN root IS NULL THEN NULL ELSE 0 END, -1) AS cluster FROM pv LEFT JOIN root ON root.id = pv.id""")
def dbscan_clusters(spark, folder):
    return Cl.density_clusters(vectors(spark, folder).select("id", "embedding"))


@query("anomaly_distance", f"""
WITH {VEC_CTE} SELECT q.id, round(-min(list_distance(q.e, k.e)) / 100, 6) AS anomaly_score, false AS no_baseline
FROM pv q JOIN pv k ON q.part_role = 'query' AND k.part_role = 'known' GROUP BY 1""")
def anomaly_distance(spark, folder):
    scored = An.distance_scores(role(spark, folder, "query"), role(spark, folder, "known"))
    return scored.withColumn("anomaly_score", F.round("anomaly_score", 6))


@query("isolation_forest")
def isolation_forest(spark, folder):
    forest = An.fit_isolation_forest(role(spark, folder, "known"))
    return An.isolation_scores(vectors(spark, folder), forest).withColumn("anomaly_score", F.round("anomaly_score", 9))


DOC_LINES_CTE = """lines AS (SELECT doc_id AS file_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no,
  unnest(string_split(text, chr(10))) AS line FROM documents)"""
FP_CTE = f"""{NODES_CTE.replace(LINES_CTE, DOC_LINES_CTE)}, nn AS (SELECT file_id, count(*) AS n FROM nodes GROUP BY 1),
dn AS (SELECT file_id, id, {sql_strip("string_split(text, '=')[1]")} AS name FROM nodes WHERE type = 'assignment'),
de AS (SELECT file_id, count(*) AS n FROM (SELECT DISTINCT file_id, src, dst FROM (SELECT u.file_id, u.id AS dst, d.name, max(d.id) AS src FROM nodes u JOIN dn d ON d.file_id = u.file_id AND d.id < u.id AND d.name <> ''
  AND contains(u.text, d.name) WHERE u.type IN ('function_call', 'return') GROUP BY 1, 2, 3)) GROUP BY 1),
fp AS (SELECT doc_id AS id, text, coalesce(nn.n, 0) AS n_nodes, greatest(coalesce(nn.n, 0) - 1, 0) + coalesce(de.n, 0) AS n_edges, coalesce(embedding::DOUBLE[], list_transform(range((SELECT max(len(embedding)) FROM embeddings)), lambda x: 0.0::DOUBLE)) AS e FROM documents d
  LEFT JOIN embeddings ON vec_id = doc_id LEFT JOIN nn ON nn.file_id = doc_id LEFT JOIN de ON de.file_id = doc_id),
fv AS (SELECT id, text, list_concat(e, [n_nodes::DOUBLE, n_edges, n_nodes / greatest(len(string_split(text, chr(10))), 1), CASE WHEN n_nodes > 0 THEN n_edges / n_nodes ELSE 0 END,
  length(text), length(text) - length(replace(text, chr(10), '')), len(list_distinct(list_filter(regexp_split_to_array(text, '{SQL_BLANK}+'), lambda w: w <> ''))),
  length(text) - length(translate(text, '()[]{{}}', '')), len(list_filter(string_split(text, chr(10)), lambda l: starts_with({sql_strip('l')}, '#'))),
  {', '.join(f"cast({sql_any('lower(text)' if folded else 'text', words)} AS int)" for _, words, folded in fixed.SEGMENT_FLAG_WORDS)}]) AS v FROM fp)"""


def document_fingerprints(spark, folder):
    docs = V.documents(spark, folder).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    vecs = V.table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    width = vecs.agg(F.max(F.size("embedding"))).scalar()
    # a text without an embedding keeps its place with a vector of zeros
    joined = docs.join(vecs, "id", "left").select("id", "content", F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), width)).alias("embedding"))
    return An.fingerprints(joined)


@query("fingerprints", f"""
WITH {FP_CTE} SELECT id, len(v) AS width, array_to_string(list_transform(v, lambda x: cast(cast(round(x * 10000) AS bigint) AS varchar)), ',') AS fingerprint FROM fv""")
def fingerprints(spark, folder):
    tenth = F.transform("fingerprint", lambda x: F.round(x * 10000).cast("long").cast("string"))
    return document_fingerprints(spark, folder).select("id", F.size("fingerprint").alias("width"), F.array_join(tenth, ",").alias("fingerprint"))


CAND_CTE = f"""{FP_CTE}, kn AS (SELECT id, v FROM fv WHERE id % 10 < 3), qn AS (SELECT * FROM fv WHERE id % 10 >= 3),
lone AS (SELECT count(*) AS n FROM kn a WHERE NOT EXISTS (SELECT 1 FROM kn b WHERE a.id <> b.id AND list_distance(a.v, b.v) <= 0.3)),
sc AS (SELECT q.id, any_value(q.text) AS text, -min(list_distance(q.v, kn.v)) / 100 AS s FROM qn q, kn GROUP BY q.id HAVING s < -0.5),
rk AS (SELECT sc.*, lone.n AS similar_count, CASE {' '.join(f"WHEN {sql_any('lower(text)', words)} THEN '{level}: {fixed.RISK_TEXT}'" for level, words in fixed.RISK_WORDS)} ELSE '{fixed.LOW_RISK_TEXT}' END AS risk,
  CASE {' '.join(f"WHEN {sql_any('lower(text)', words)} THEN '{cwe}'" for cwe, words in fixed.CWE_WORDS)} END AS cwe FROM sc, lone),
cand AS (SELECT *, greatest(0, least(1, 0.5 + CASE WHEN s < -1 THEN 0.3 ELSE 0.2 END + CASE WHEN contains(risk, 'CRITICAL') THEN 0.2 WHEN contains(risk, 'HIGH') THEN 0.1 ELSE 0 END
  - CASE WHEN similar_count > 3 THEN 0.1 WHEN similar_count > 0 THEN 0.05 ELSE 0 END)) AS confidence FROM rk)"""


def candidates(spark, folder):
    rows = document_fingerprints(spark, folder)
    return An.anomaly_candidates(rows.filter("id % 10 >= 3"), rows.filter("id % 10 < 3"))


@query("anomaly_candidates", f"""
WITH {CAND_CTE} SELECT id, concat('ZERO-DAY-', md5(text)) AS candidate_id, round(s, 4) AS anomaly_score, similar_count, risk AS risk_assessment, cwe AS predicted_cwe, round(confidence, 4) AS confidence
FROM cand WHERE confidence > 0.6""")
def anomaly_candidates(spark, folder):
    return candidates(spark, folder).withColumns({c: F.round(c, 4) for c in ("anomaly_score", "confidence")})


@query("forest_candidates")
def forest_candidates(spark, folder):
    """Candidates by the isolation forest: rows whose score and confidence pass, whatever their distance to the known ones."""
    rows = document_fingerprints(spark, folder)
    found = An.anomaly_candidates(rows.filter("id % 10 >= 3"), rows.filter("id % 10 < 3"), score=An.forest_scores)
    return found.withColumns({c: F.round(c, 4) for c in ("anomaly_score", "confidence")})


@query("candidates_file", f"""
WITH {CAND_CTE} SELECT id, concat('ZERO-DAY-', md5(text)) AS candidate_id, round(s, 4) AS anomaly_score, similar_count, risk AS risk_assessment, cwe AS predicted_cwe, round(confidence, 4) AS confidence
FROM cand WHERE confidence > 0.6""")
def candidates_file(spark, folder):
    """Candidates saved as documents and loaded again."""
    path = new_run_folder(spark, "candidates")
    stored.save_documents(stored.candidates_document(candidates(spark, folder)), path)
    back = stored.candidates_from_documents(stored.load_documents(spark, path))
    return back.withColumns({c: F.round(c, 4) for c in ("anomaly_score", "confidence")})


@query("similar_known", f"""
WITH RECURSIVE {VEC_CTE}, kn AS (SELECT * FROM pv WHERE part_role = 'known'),
e AS (SELECT a.id AS a, b.id AS b FROM kn a JOIN kn b ON a.id <> b.id AND list_distance(a.e, b.e) <= 0.3),
reach AS (SELECT a AS id, a AS r FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.id),
root AS (SELECT id, min(r) AS root FROM reach GROUP BY id), sizes AS (SELECT root, count(*) AS members FROM root GROUP BY root),
lone AS (SELECT count(*) AS n FROM kn WHERE id NOT IN (SELECT id FROM root)),
near AS (SELECT DISTINCT q.id, coalesce(root.root, kn.id) AS place, coalesce(members, 1) AS members FROM pv q JOIN kn ON list_distance(q.e, kn.e) <= 0.3
  LEFT JOIN root ON root.id = kn.id LEFT JOIN sizes ON sizes.root = root.root WHERE q.part_role = 'query'),
total AS (SELECT id, sum(members) AS members FROM near GROUP BY id)
SELECT q.id, cast(coalesce(total.members, lone.n) AS bigint) AS similar_count FROM pv q CROSS JOIN lone LEFT JOIN total ON total.id = q.id WHERE q.part_role = 'query'""")
def similar_known(spark, folder):
    return An.similar_known(role(spark, folder, "query"), role(spark, folder, "known"))


@query("anomaly_summary", f"""
WITH {VEC_CTE}, d AS (SELECT id, detected_at AS first_seen, confidence_score AS confidence, concat(upper(severity), ': detail') AS risk,
    CASE WHEN pattern_id < 4 THEN concat('CWE-', pattern_id) END AS cwe FROM v_detections)
SELECT 'total_candidates' AS measure, '' AS key, count(*) AS value FROM d UNION ALL SELECT 'high_confidence', '', count(*) FILTER (confidence > 0.8) FROM d
UNION ALL SELECT 'recent_24h', '', count(*) FILTER (first_seen > {V.AS_OF_SQL} - INTERVAL 24 HOUR) FROM d
UNION ALL SELECT 'risk_distribution', string_split(risk, ':')[1], count(*) FROM d GROUP BY 2
UNION ALL SELECT 'predicted_cwes', cwe, count(*) FROM d WHERE cwe IS NOT NULL GROUP BY 2
UNION ALL SELECT 'evolution_patterns', '', count(*) FROM pv WHERE part_role = 'mutation'""")
def anomaly_summary(spark, folder):
    """Stored candidates are read off the finding table, which has their columns."""
    stored = V.detections(spark, folder).select(
        F.col("detected_at").alias("first_seen"), F.col("confidence_score").alias("confidence"),
        F.concat(F.upper("severity"), F.lit(": detail")).alias("risk_assessment"),
        F.when(F.col("pattern_id") < 4, F.concat(F.lit("CWE-"), F.col("pattern_id").cast("string"))).alias("predicted_cwe"))
    return An.anomaly_summary(stored, role(spark, folder, "mutation"), V.as_of())


@query("type_keys", f"""
SELECT detection_id, CASE WHEN contains(vulnerability_type, 'SQL Injection') THEN 'sql_injection' WHEN contains(vulnerability_type, 'Cross-Site Scripting') THEN 'xss'
  WHEN contains(vulnerability_type, 'Command Injection') THEN 'command_injection' ELSE replace(lower(vulnerability_type), ' ', '_') END AS type_key FROM v_feedback""")
def type_keys(spark, folder):
    return V.feedback(spark, folder).select("detection_id", Sim.type_key(F.col("vulnerability_type")).alias("type_key"))


@query("embed_misses", """
WITH k AS (SELECT d.doc_id, md5(concat(lang, ':', text)) AS code_key, l.doc_id IS NOT NULL AS cached FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT code_key, count(*) AS waiting FROM k WHERE code_key NOT IN (SELECT code_key FROM k WHERE cached) GROUP BY 1""")
def embed_misses(spark, folder):
    """Texts without a cached embedding, each once, with how many rows wait for it."""
    docs = V.documents(spark, folder).select("doc_id", T.code_key(F.col("lang"), F.col("text")).alias("code_key"))
    cache = docs.join(V.table(spark, folder, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    waiting = docs.groupBy("code_key").agg(F.count("*").alias("waiting"))
    return Sim.cache_misses(waiting, cache)


@query("embedded_texts", """
WITH k AS (SELECT DISTINCT md5(concat(lang, ':', text)) AS code_key, text FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
w AS (SELECT code_key, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM k),
b AS (SELECT code_key, CAST(('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS INT) AS bucket, count(*)::DOUBLE AS words FROM w GROUP BY 1, 2)
SELECT code_key, bucket, words, (SELECT count(*) FROM k) AS embedded FROM b""")
def embedded_texts(spark, folder):
    """Embeddings of two runs over one cache: each different text is embedded once, by the first."""
    path = new_run_folder(spark, "embeddings")
    docs = V.documents(spark, folder).select(F.col("text").alias("code"), T.code_key(F.col("lang"), F.col("text")).alias("code_key")).filter("code_key IS NOT NULL")
    for _ in range(2):
        embedded = Sim.embed_through_cache(docs, path)
    written = spark.read.parquet(path).agg(F.count("*")).scalar()
    each = embedded.select("code_key", "embedding").dropDuplicates(["code_key"]).select("code_key", F.posexplode("embedding").alias("bucket", "words"))
    return each.filter("words > 0").select("code_key", "bucket", F.col("words").cast("double").alias("words"), written.alias("embedded"))
