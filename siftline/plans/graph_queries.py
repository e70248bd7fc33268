"""Queries over code graphs."""
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from .. import views as V
from ..operators import graph as G
from ..operators import model_findings as M
from ..operators import scan as C
from ..operators import segments as S
from ..session import unfolded
from .registry import SQL_BLANK, query, sql_any, sql_count, sql_list, sql_strip, sql_text, sql_values
from .scan_queries import LINES_CTE, LOCATED_CTE, blocks_sql, scored_files

W = fixed.LINE_TYPE_WORDS
NODES_CTE = f"""{LINES_CTE}, raw AS (SELECT file_id, line_no AS line, {sql_strip('line')} AS text FROM lines),
typed AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line) - 1 AS id,
  CASE WHEN {sql_any('text', W['declaration'])} THEN CASE WHEN contains(text, '(') AND contains(text, ')') THEN 'function_def' ELSE 'var_declaration' END
  WHEN {sql_any('text', W['control_flow'])} THEN 'control_flow' WHEN contains(text, 'return') THEN 'return'
  WHEN contains(text, '=') AND NOT contains(text, '==') THEN 'assignment' WHEN {sql_any('text', W['function_call'])} THEN 'function_call'
  WHEN {sql_any('text', W['potential_vulnerability'])} THEN 'potential_vulnerability' WHEN {sql_any('text', W['import'])} THEN 'import' ELSE 'statement' END AS type
  FROM raw WHERE text <> '' AND NOT starts_with(text, '//') AND NOT starts_with(text, '#')),
named AS (SELECT *, CASE WHEN NOT (type IN ('function_def', 'function_call') OR contains(text, 'int main')) THEN NULL WHEN contains(text, 'main') THEN 'main'
  WHEN len(list_filter(regexp_split_to_array(string_split(text, '(')[1], '{SQL_BLANK}+'), lambda w: w <> '')) >= 2
  THEN list_filter(regexp_split_to_array(string_split(text, '(')[1], '{SQL_BLANK}+'), lambda w: w <> '')[-1] ELSE 'unknown' END AS named FROM typed),
nodes AS (SELECT file_id, id, line, text, type, last_value(named IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS function FROM named)"""


def files(spark, folder):
    return V.code_files(spark, folder)


@query("graph_nodes", f"WITH {NODES_CTE} SELECT file_id, id, line, text, type FROM nodes")
def graph_nodes(spark, folder):
    return G.graph_nodes(files(spark, folder)).select("file_id", "id", "line", "text", "type")


@query("function_context", f"WITH {NODES_CTE} SELECT file_id, id, function FROM nodes")
def function_context(spark, folder):
    return G.graph_nodes(files(spark, folder)).select("file_id", "id", "function")


@query("nearby_nodes", f"""
WITH {NODES_CTE} SELECT a.file_id, a.id, b.id AS other_id, b.type AS other_type FROM nodes a JOIN nodes b ON a.file_id = b.file_id AND abs(a.line - b.line) <= 2 AND a.id <> b.id""")
def nearby_nodes(spark, folder):
    return G.nearby_nodes(files(spark, folder))


@query("node_context", f"""
WITH {NODES_CTE}, near AS (SELECT a.file_id, a.id, string_agg(b.type, ',' ORDER BY b.id) AS t FROM nodes a JOIN nodes b ON a.file_id = b.file_id AND abs(a.line - b.line) <= 2 AND a.id <> b.id GROUP BY 1, 2)
SELECT n.file_id, n.id, n.function, {sql_any('lower(text)', fixed.NODE_MEMORY_WORDS)} AS has_memory_ops, {sql_any('lower(text)', fixed.NODE_INPUT_WORDS)} AS has_user_input,
  {sql_any('lower(text)', fixed.NODE_OUTPUT_WORDS)} AS has_output, coalesce(near.t, '') AS nearby_types FROM nodes n LEFT JOIN near ON near.file_id = n.file_id AND near.id = n.id""")
def node_context(spark, folder):
    return G.node_context(files(spark, folder))


def _i(test):
    return f"cast({test} AS int)"


FEATURE_SQL = ", ".join(
    [_i(f"type = '{s}'") for s in fixed.NODE_TYPE_SLOTS]
    + [_i(sql_any("lower(text)", [w.lower() for w in ws])) for _, ws in fixed.NODE_PATTERN_WORDS]
    + [_i(sql_any("lower(text)", [w.lower() for w in ws])) for _, ws in fixed.NODE_SEMANTIC_WORDS]
    + ["length(text)", "0"] + [sql_count("text", m) for m in "([{;"]
    + [f"len(list_filter(regexp_split_to_array(text, '{SQL_BLANK}+'), lambda w: w <> ''))"]
    + [_i(sql_any("text", ws)) for ws in (["*"], ["[]"], ["->", "."])]
    + [_i(sql_any("text", ws)) for _, ws in fixed.NODE_SECURITY_WORDS]
    + [_i("length(text) > 100"), _i(f"{sql_count('text', '*')} > 1"), _i(sql_any("text", fixed.NODE_TYPE_MODIFIERS)), _i(sql_any("text", fixed.NODE_FORMAT_MARKS))]
    + [_i(sql_any("lower(text)", ["input", "user"])), _i(sql_any("lower(text)", ["output", "print"])), _i("contains(text, '=') AND NOT contains(text, '==')"),
       _i("contains(text, 'return')"), _i(sql_any("text", fixed.NODE_PARAMETER_WORDS)), _i(sql_any("text", fixed.NODE_GLOBAL_WORDS))])


@query("node_features", f"WITH {NODES_CTE} SELECT file_id, id, array_to_string([{FEATURE_SQL}], ',') AS features FROM nodes")
def node_features(spark, folder):
    n = G.graph_nodes(files(spark, folder))
    return n.select("file_id", "id", F.array_join(G.node_features(F.col("text"), F.col("type")).cast("array<int>").cast("array<string>"), ",").alias("features"))


@query("graph_pooling", f"""
WITH {NODES_CTE}, f AS (SELECT file_id, [{FEATURE_SQL}] AS v FROM nodes), x AS (SELECT file_id, unnest(range(0, 62)) AS dim, unnest(v) AS value FROM f)
SELECT file_id, dim, round(avg(value), 4) AS mean, cast(max(value) AS bigint) AS max, cast(sum(value) AS bigint) AS sum FROM x GROUP BY 1, 2""")
def graph_pooling(spark, folder):
    pooled = G.pooled_features(files(spark, folder))
    return pooled.select("file_id", F.col("dim").cast("long").alias("dim"), F.round("mean", 4).alias("mean"),
                         F.col("max").cast("long").alias("max"), F.col("sum").cast("long").alias("sum"))


EDGES_CTE = f"""{NODES_CTE}, vs AS (SELECT file_id, id, unnest(regexp_extract_all(text, '([\\p{{L}}\\p{{N}}_]+){SQL_BLANK}*=', 1)) AS name FROM nodes),
cs AS (SELECT file_id, id, unnest(regexp_extract_all(text, '([\\p{{L}}\\p{{N}}_]+){SQL_BLANK}*\\(', 1)) AS name FROM nodes),
df AS (SELECT DISTINCT vs.file_id, vs.id AS src, n.id AS dst FROM vs JOIN nodes n ON n.file_id = vs.file_id AND contains(n.text, vs.name) AND NOT contains(n.text, concat(vs.name, '='))),
cf AS (SELECT DISTINCT cs.file_id, cs.id AS src, n.id AS dst FROM cs JOIN nodes n ON n.file_id = cs.file_id AND contains(n.text, concat(cs.name, '('))),
pr AS (SELECT a.file_id, a.id AS src, b.id AS dst, coalesce(a.function = b.function AND a.function <> '', false) AS ast_child, abs(a.line - b.line) = 1 AS control_flow,
  {sql_any('a.text', fixed.ALLOC_WORDS)} AND {sql_any('b.text', fixed.FREE_WORDS)} AS memory_flow,
  {' OR '.join(f"(contains(lower(a.text), '{x}') AND contains(lower(b.text), '{y}'))" for x, y in fixed.VULNERABLE_PAIRS)} AS vulnerability
  FROM nodes a JOIN nodes b ON a.file_id = b.file_id AND a.id <> b.id),
edges AS (SELECT pr.file_id, pr.src, pr.dst, cast(ast_child AS int) AS ast_child, cast(df.src IS NOT NULL AS int) AS data_flow, cast(control_flow AS int) AS control_flow,
  cast(cf.src IS NOT NULL AS int) AS call_flow, cast(memory_flow AS int) AS memory_flow, 0 AS pointer_flow, 0 AS semantic, cast(vulnerability AS int) AS vulnerability
  FROM pr LEFT JOIN df ON df.file_id = pr.file_id AND df.src = pr.src AND df.dst = pr.dst LEFT JOIN cf ON cf.file_id = pr.file_id AND cf.src = pr.src AND cf.dst = pr.dst
  WHERE ast_child OR control_flow OR memory_flow OR vulnerability OR df.src IS NOT NULL OR cf.src IS NOT NULL)"""


@query("graph_edges", f"WITH {EDGES_CTE} SELECT * FROM edges")
def graph_edges(spark, folder):
    return G.graph_edges(files(spark, folder))


@query("graph_stats", f"""
WITH {EDGES_CTE}, n AS (SELECT file_id, count(*) AS n FROM nodes GROUP BY 1), e AS (SELECT file_id, count(*) AS e FROM edges GROUP BY 1)
SELECT n.file_id, n AS num_nodes, coalesce(e, 0) AS num_edges, round(coalesce(e, 0) / n, 4) AS edges_per_node,
  CASE WHEN n > 1 THEN round(coalesce(e, 0) / (n * (n - 1)), 4) ELSE 0 END AS density, round(coalesce(e, 0) / (n * n), 4) AS square_density FROM n LEFT JOIN e ON e.file_id = n.file_id""")
def graph_stats(spark, folder):
    s = G.graph_stats(files(spark, folder))
    return s.withColumns({c: F.round(c, 4) for c in ("edges_per_node", "density", "square_density")})


@query("file_features", f"""
WITH {EDGES_CTE}, n AS (SELECT file_id, count(*) AS n FROM nodes GROUP BY 1), e AS (SELECT file_id, count(*) AS e FROM edges GROUP BY 1)
SELECT f.file_id, n AS graph_nodes, coalesce(e, 0) AS graph_edges, round(coalesce(e, 0) / (n * n), 4) AS graph_density, len(string_split(content, chr(10))) AS code_lines,
  {sql_any('lower(content)', fixed.FEATURE_INPUT_WORDS)} AS has_user_input, {sql_any('content', fixed.DANGEROUS_WORDS)} AS has_dangerous_functions,
  {sql_any('upper(content)', fixed.SQL_WORDS)} AS has_sql_keywords FROM v_code_files f JOIN n ON n.file_id = f.file_id LEFT JOIN e ON e.file_id = f.file_id""")
def file_features(spark, folder):
    code = files(spark, folder)
    flags = code.select("file_id", *[c.alias(n) for n, c in S.file_flags(F.col("content")).items()])
    stats = G.graph_stats(code).select("file_id", F.col("num_nodes").alias("graph_nodes"), F.col("num_edges").alias("graph_edges"),
                                       F.round("square_density", 4).alias("graph_density"))
    return stats.join(unfolded(flags), "file_id")


@query("follows_edges", f"""
WITH {NODES_CTE} SELECT file_id, src, dst FROM (SELECT file_id, id AS src, lead(id) OVER (PARTITION BY file_id ORDER BY line) AS dst FROM nodes) WHERE dst IS NOT NULL""")
def follows_edges(spark, folder):
    return G.follows_edges(files(spark, folder))


@query("definition_edges", f"""
WITH {NODES_CTE}, d AS (SELECT file_id, id, {sql_strip("string_split(text, '=')[1]")} AS name FROM nodes WHERE type = 'assignment')
SELECT DISTINCT file_id, src, dst FROM (SELECT u.file_id, u.id AS dst, d.name, max(d.id) AS src FROM nodes u JOIN d ON d.file_id = u.file_id AND d.id < u.id AND d.name <> '' AND contains(u.text, d.name)
WHERE u.type IN ('function_call', 'return') GROUP BY 1, 2, 3)""")
def definition_edges(spark, folder):
    return G.definition_edges(files(spark, folder))


@query("node_type_counts", f"WITH {NODES_CTE} SELECT file_id, type, count(*) AS count FROM nodes GROUP BY 1, 2")
def node_type_counts(spark, folder):
    return G.node_type_counts(files(spark, folder))


LINKS_CTE = f"""d AS (SELECT file_id, id, {sql_strip("string_split(text, '=')[1]")} AS name FROM nodes WHERE type = 'assignment'),
links AS (SELECT file_id, src, dst FROM (SELECT file_id, id AS src, lead(id) OVER (PARTITION BY file_id ORDER BY line) AS dst FROM nodes) WHERE dst IS NOT NULL
  UNION SELECT file_id, src, dst FROM (SELECT u.file_id, u.id AS dst, d.name, max(d.id) AS src FROM nodes u
    JOIN d ON d.file_id = u.file_id AND d.id < u.id AND d.name <> '' AND contains(u.text, d.name) WHERE u.type IN ('function_call', 'return') GROUP BY 1, 2, 3))"""


def central_sql(over: float) -> str:
    """``central(file_id, id, line, centrality)`` by counting shortest paths recursively; needs ``nodes``."""
    return f"""{LINKS_CTE},
walks AS (SELECT file_id, src AS s, dst AS v, 1 AS d FROM links
  UNION ALL SELECT w.file_id, w.s, l.dst, w.d + 1 FROM walks w JOIN links l ON l.file_id = w.file_id AND l.src = w.v),
counted AS (SELECT file_id, s, v, d, count(*)::DOUBLE AS c FROM walks GROUP BY ALL),
short AS (SELECT * FROM counted QUALIFY d = min(d) OVER (PARTITION BY file_id, s, v)),
sizes AS (SELECT file_id, count(*) AS n FROM nodes GROUP BY 1),
shares AS (SELECT a.file_id, a.v AS id, sum(a.c * b.c / t.c) AS share FROM short a JOIN short b ON b.file_id = a.file_id AND b.s = a.v
  JOIN short t ON t.file_id = a.file_id AND t.s = a.s AND t.v = b.v AND t.d = a.d + b.d GROUP BY 1, 2),
scored AS (SELECT shares.file_id, shares.id, line, round(share / ((n - 1) * (n - 2)), 9) AS centrality
  FROM shares JOIN sizes ON sizes.file_id = shares.file_id JOIN nodes ON nodes.file_id = shares.file_id AND nodes.id = shares.id),
central AS (SELECT * FROM scored WHERE centrality > {over} QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY centrality DESC, id) <= 5)"""


HOT_CTE = "hot AS (SELECT file_id, min(line) AS hot_lo, max(line) AS hot_hi FROM central GROUP BY 1)"
HOT_SNIPPET_SQL = f"""CASE WHEN hot_lo IS NULL THEN '{fixed.NO_LOCATION}' ELSE
  array_to_string(list_slice(string_split(content, chr(10)), greatest(0, hot_lo - 3) + 1, least(n_lines, hot_hi + 2)), chr(10)) END"""


@query("central_lines", f"""
WITH RECURSIVE {NODES_CTE}, {central_sql(0.1)} SELECT file_id, line, round(centrality, 6) AS centrality FROM central""")
def central_lines(spark, folder):
    return G.central_lines(files(spark, folder)).withColumn("centrality", F.round("centrality", 6))


def located_files(spark, folder, over):
    """Scored files with their central lines."""
    return scored_files(spark, folder).join(unfolded(G.hot_lines(files(spark, folder), over=over)), "file_id", "left")


HYBRID_SEVERITY_SQL = f"""CASE WHEN vulnerability_type IN ({sql_list(fixed.CRITICAL_TYPES)}) AND score * type_confidence > 0.7 THEN 'critical'
WHEN vulnerability_type IN ({sql_list(fixed.CRITICAL_TYPES)}) OR (vulnerability_type IN ({sql_list(fixed.HIGH_TYPES)}) AND score * type_confidence > 0.6) THEN 'high'
WHEN score * type_confidence > 0.5 THEN 'medium' ELSE 'low' END"""
GRAPH_SEVERITY_SQL = f"""CASE WHEN vulnerability_type IN ({sql_list(fixed.CRITICAL_TYPES)}) AND score > 0.8 THEN 'critical'
WHEN vulnerability_type IN ({sql_list(fixed.CRITICAL_TYPES)}) OR (vulnerability_type IN ({sql_list(fixed.HIGH_TYPES)}) AND score > 0.85) THEN 'high'
WHEN score > 0.8 THEN 'medium' ELSE 'low' END"""
TYPE_TABLES_CTE = ", ".join([sql_values("type_cwe", ["kind", "cwe_id"], list(fixed.TYPE_CWE.items())),
                             sql_values("type_fix", ["kind", "fix"], list(fixed.TYPE_FIX.items()))])


@query("score_findings", f"""
WITH RECURSIVE {LOCATED_CTE}, {NODES_CTE.removeprefix(LINES_CTE + ', ')}, {central_sql(0.1)}, {TYPE_TABLES_CTE}, {HOT_CTE}, n AS (SELECT snips.*, len(string_split(content, chr(10))) AS n_lines, replace(vulnerability_type, ' ', '_') AS tag, hot_lo, hot_hi FROM snips LEFT JOIN hot ON hot.file_id = snips.file_id)
SELECT concat('HYBRID-', file_path, '-', tag) AS finding_id, concat('Hybrid AI: ', vulnerability_type) AS name, {HYBRID_SEVERITY_SQL} AS severity,
  round(type_confidence, 4) AS confidence, file_path, lo AS line_start, hi AS line_end, snip AS code_snippet,
  type_cwe.cwe_id, type_fix.fix AS fix_suggestion FROM n JOIN type_cwe ON type_cwe.kind = vulnerability_type JOIN type_fix ON type_fix.kind = vulnerability_type
  WHERE score > 0.4 AND type_confidence > 0.4
UNION ALL SELECT concat('HYBRID-COMPLEXITY-', file_path), 'High Code Complexity', 'low', 0.7, file_path, 1, n_lines, '[Full file - complex structure]', NULL, NULL FROM n WHERE graph_density > 0.15
UNION ALL SELECT concat('GNN-', file_path, '-', tag), concat('GNN: Structural ', vulnerability_type, ' Pattern'), {GRAPH_SEVERITY_SQL}, round(score * type_confidence, 4), file_path, coalesce(hot_lo, 1), coalesce(hot_hi, n_lines),
  {HOT_SNIPPET_SQL}, type_cwe.cwe_id, type_fix.fix FROM n JOIN type_cwe ON type_cwe.kind = vulnerability_type JOIN type_fix ON type_fix.kind = vulnerability_type WHERE score > 0.7
UNION ALL SELECT concat('GNN-COMPLEXITY-', file_path), 'Complex/Suspicious Code Structure', 'medium', 0.75, file_path, 1, n_lines, '[Full file analysis]', NULL, NULL FROM n WHERE graph_density > 0.3""")
def score_findings(spark, folder):
    scored = located_files(spark, folder, 0.1).withColumn("suspicious_ratio", F.col("graph_density"))
    found = C.union_findings(M.hybrid_findings(scored), M.dense_code_findings(scored), M.graph_findings(scored),
                             M.suspicious_structure_findings(scored))
    return found.select("finding_id", "name", "severity", F.round("confidence", 4).alias("confidence"), "file_path",
                        "line_start", "line_end", "code_snippet", "cwe_id", "fix_suggestion")


#: An untrained model's probabilities count three tenths and must exceed 0.85, which the sum over four of its runs can.
RUNS = 4


@query("score_findings_untrained", f"""
WITH RECURSIVE {LOCATED_CTE}, {NODES_CTE.removeprefix(LINES_CTE + ', ')}, {central_sql(0.3)}, {TYPE_TABLES_CTE}, {HOT_CTE},
n AS (SELECT snips.*, len(string_split(content, chr(10))) AS n_lines, score * {RUNS} * 0.3::DOUBLE AS p, hot_lo, hot_hi FROM snips LEFT JOIN hot ON hot.file_id = snips.file_id)
SELECT concat('GNN-', file_path, '-', replace(vulnerability_type, ' ', '_')) AS finding_id,
  CASE WHEN vulnerability_type IN ({sql_list(fixed.CRITICAL_TYPES)}) AND p > 0.9 THEN 'high' ELSE 'low' END AS severity,
  round(p * type_confidence * 0.3::DOUBLE, 4) AS confidence, file_path, coalesce(hot_lo, 1) AS line_start, coalesce(hot_hi, n_lines) AS line_end,
  {HOT_SNIPPET_SQL} AS code_snippet, concat('{fixed.GRAPH_MAYBE}', vulnerability_type, '. {fixed.GRAPH_UNTRAINED_NOTE}') AS description
FROM n WHERE p > 0.85""")
def score_findings_untrained(spark, folder):
    scored = located_files(spark, folder, 0.3).withColumns({"suspicious_ratio": F.col("graph_density"), "score": F.col("score") * RUNS})
    found = M.graph_findings(scored, trained=False)
    return found.select("finding_id", "severity", F.round("confidence", 4).alias("confidence"), "file_path", "line_start", "line_end",
                        "code_snippet", "description")


@query("risk_factors", f"""
SELECT file_id, concat_ws(',', {', '.join(f"CASE WHEN contains(content, {sql_text(w)}) THEN {sql_text(w)} END" for w in fixed.INDICATOR_WORDS)}) AS indicators,
  {sql_any('content', fixed.INDICATOR_WORDS)} AS has_vulnerabilities, concat_ws(',', CASE WHEN contains(content, 'malloc') AND NOT contains(content, 'free') THEN 'Memory leak potential' END,
  CASE WHEN contains(content, 'strcpy') OR contains(content, 'gets') THEN 'Buffer overflow risk' END, CASE WHEN contains(content, 'system') OR contains(content, 'exec') THEN 'Command injection risk' END) AS factors,
  round(len(string_split(content, chr(10))) / 10, 4) AS complexity_score FROM v_code_files""")
def risk_factors(spark, folder):
    return files(spark, folder).select("file_id", *[(F.round(c, 4) if n == "complexity_score" else c).alias(n)
                                                    for n, c in G.risk_factors(F.col("content")).items()])


@query("block_features", f"""
WITH {blocks_sql('v_code_files', 'file_id', True)} SELECT file_id, start_line, {sql_any("string_split(code, chr(10))[1]", fixed.BLOCK_STARTS)} AS is_function,
  len(list_filter(string_split(code, chr(10)), lambda l: {sql_strip('l')} <> '')) AS children, line_count AS lines, length(code) AS chars,
  length(code) - length(replace(code, chr(10), '')) AS newlines, {', '.join(f"{sql_count('code', w)} AS n_{w.strip()}" for w in fixed.BLOCK_COUNT_WORDS)},
  {', '.join(f"contains(code, '{w}') AS has_{w}" for w in ['eval', 'exec', 'system'])}, contains(lower(code), 'sql') AS has_sql,
  {', '.join(f"contains(upper(code), '{w}') AS has_{w.lower()}" for w in fixed.SQL_WORDS)} FROM blocks""")
def block_features(spark, folder):
    return G.block_features(files(spark, folder))
