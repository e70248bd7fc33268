"""Line-level detection: rule regexes and risky keywords over a corpus of files.

A file stays one row until its lines are exploded; every step up to the findings is a
narrow projection, so scanning needs no shuffle and no join on a regex.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import text as T
from ..functions.lookup import literal_lookup
from ..sources.rules import REGEX_FLAGS, normalise_regex, required_text, rule_table

ANALYZER_ORDER = {"pattern": 0, "keyword": 1, "complexity": 2, "model": 3}

FINDING_COLUMNS = [
    "finding_id", "analyzer", "analyzer_ord", "rule_ord", "regex_ord", "name", "description", "severity",
    "confidence", "file_path", "line_start", "line_end", "code_snippet", "cwe_id", "fix_suggestion",
    "ai_explanation",
]


def explode_lines(files: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, line_no from 1, line) for every line of ``content``."""
    return files.select(*keep, F.posexplode(T.split_lines("content")).alias("pos", "line")).select(
        *keep, (F.col("pos") + 1).alias("line_no"), "line"
    )


def is_comment(line: Column, language: Column) -> Column:
    stripped = T.strip(line)
    return (language.isin(fixed.HASH_COMMENT_LANGUAGES) & F.startswith(stripped, F.lit("#"))) | (
        language.isin(fixed.SLASH_COMMENT_LANGUAGES) & F.startswith(stripped, F.lit("//"))
    )


def code_lines(files: DataFrame) -> DataFrame:
    """Non-blank lines that are not comments of their language."""
    lines = explode_lines(files, "file_id", "file_path", "language")
    return lines.filter(~T.is_blank("line") & ~is_comment(F.col("line"), F.col("language")))


def match_confidence(line: Column, severity: Column) -> Column:
    """Base 0.8, raised for concatenated or interpolated SQL and critical rules, lowered in comments."""
    upper = F.upper(line)
    joined_sql = F.contains(line, F.lit("+")) & T.contains_any(upper, ["WHERE", "SELECT"])
    f_string_sql = T.contains_any(line, ['f"', "f'"]) & T.contains_any(upper, fixed.SQL_WORDS)
    commented = T.starts_with_any(T.strip(line), fixed.COMMENT_STARTS)
    score = F.lit(0.8)
    score = score + F.when(joined_sql, 0.15).otherwise(0.0)
    score = score + F.when(f_string_sql, 0.1).otherwise(0.0)
    score = score + F.when(severity == "critical", 0.05).otherwise(0.0)
    score = score - F.when(commented, 0.4).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def regex_hits_sql(line: str, language: str, rules: list) -> str:
    """SQL for the array of (rule, regex position) pairs whose regex is found in the line.

    All regexes are literals, compiled once per task; only those of the line's own language
    are evaluated, and only where the literal text they need is present.  The text is one
    expression so that building the plan stays cheap with many rules.
    """
    branches = []
    for lang in dict.fromkeys(l for _, l, _ in rules):
        tests = []
        for i, (rule_id, l, regex) in enumerate(rules):
            if l == lang:
                regex = normalise_regex(regex)
                needed = required_text(regex)
                gate = f"contains(low, {_sql_text(needed)}) AND " if needed else ""
                tests.append(
                    f"CASE WHEN {gate}{line} RLIKE {_sql_text(REGEX_FLAGS + regex)} "
                    f"THEN named_struct('rule_id', {_sql_text(rule_id)}, 'regex_ord', {i}) END")
        branches.append(f"WHEN {language} = {_sql_text(lang)} THEN array_compact(array({', '.join(tests)}))")
    # caseless matching counts long s and dotless i as s and i
    low = f"translate(lower({line}), '\u017f\u0131', 'si')"
    return f"transform(array({low}), low -> CASE {' '.join(branches)} END)[0]"


def fix_text(fix: Column, alternatives: Column, language: Column) -> Column:
    example = F.try_element_at(alternatives, language)
    return F.when(example.isNotNull(), F.concat(fix, F.lit("\n\nExample: "), example)).otherwise(fix)


def severity_name(value: Column) -> Column:
    known = {s: s for s in fixed.SEVERITY_ORDER}
    return literal_lookup(F.lower(value), known, fixed.DEFAULT_SEVERITY)


def rule_hits(files: DataFrame, regexes: list | None = None) -> DataFrame:
    """Raw (line, rule, regex) matches with their rule attributes and confidence."""
    spark = files.sparkSession
    lines = code_lines(files)
    hits = lines.withColumn(
        "hit", F.explode(F.expr(regex_hits_sql("line", "language", regexes or fixed.RULE_REGEXES)))
    ).select("*", "hit.rule_id", "hit.regex_ord").drop("hit")
    rules = rule_table(spark)
    return hits.join(F.broadcast(rules), "rule_id").withColumn(
        "confidence", match_confidence(F.col("line"), F.col("severity"))
    )


def rule_findings(files: DataFrame, regexes: list | None = None) -> DataFrame:
    hits = rule_hits(files, regexes).filter(F.col("confidence") >= F.col("threshold"))
    return _placed(hits, [*_rule_columns(), "regex_ord", "description", severity_name(F.col("severity")).alias("severity")])


def fallback_findings(files: DataFrame, regexes: list) -> DataFrame:
    """Findings of rules that fell back to a plain call regex; comments are not skipped."""
    lines = explode_lines(files, "file_path", "language")
    wanted = {r[2]: r for r in fixed.FALLBACK_RULES}
    tests = [
        F.when(
            (F.col("language") == language) & F.col("line").rlike(REGEX_FLAGS + regex),
            F.struct(*[F.lit(v).alias(n) for n, v in zip(
                ["rule_id", "name", "description", "cwe_id", "fix_suggestion"],
                [rule_id, *wanted[rule_id][3:7]])]),
        )
        for rule_id, language, regex, is_fallback in regexes if is_fallback
    ]
    if not tests:
        tests = [F.lit(None).cast("struct<rule_id:string,name:string,description:string,cwe_id:string,fix_suggestion:string>")]
    hits = lines.withColumn("hit", F.explode(F.array_compact(F.array(*tests))))
    return hits.select(
        F.concat_ws("-", F.col("hit.rule_id"), "file_path", F.col("line_no").cast("string")).alias("finding_id"),
        "hit.name", "hit.description",
        F.lit(fixed.FALLBACK_SEVERITY).alias("severity"),
        F.lit(fixed.FALLBACK_CONFIDENCE).alias("confidence"),
        "file_path", F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"),
        T.strip("line").alias("code_snippet"), "hit.cwe_id", "hit.fix_suggestion",
    )


def _keyword_test(keyword: str, language: str, line: Column) -> Column:
    if keyword == "exec":
        if language != "python":
            return F.lit(False)
        return line.rlike(r"(?U)\bexec\s*\(") & ~line.rlike(r"(?U)\.\s*execute\s*\(")
    present = F.contains(line, F.lit(keyword))
    if keyword == "subprocess.call":
        return present & F.contains(line, F.lit("shell=True"))
    if keyword == "eval":
        return present & line.rlike(r"(?U)\beval\s*\(")
    return present


def _keyword_hits(language_column: str, line: str) -> Column:
    """array<struct<keyword_ord, keyword, risk, severity>> of the risky calls in a line of its language."""
    hits = None
    for language in dict.fromkeys(l for l, _, _ in fixed.KEYWORD_RISKS):
        tests = [
            F.when(
                _keyword_test(keyword, language, F.col(line)),
                F.struct(
                    F.lit(i).alias("keyword_ord"), F.lit(keyword).alias("keyword"), F.lit(risk).alias("risk"),
                    F.lit("high" if "injection" in risk else "medium").alias("severity"),
                ),
            )
            for i, (l, keyword, risk) in enumerate(fixed.KEYWORD_RISKS) if l == language
        ]
        found = F.array_compact(F.array(*tests))
        is_language = F.col(language_column) == language
        hits = F.when(is_language, found) if hits is None else hits.when(is_language, found)
    return hits


def _keyword_columns(keyword: Column) -> list:
    """What a keyword finding says, besides its severity, risk and place in the order."""
    return [
        F.concat(F.lit("PARSE-"), F.upper("language"), F.lit("-"), F.format_string("%04d", "line_no")).alias("finding_id"),
        F.lit("keyword").alias("analyzer"),
        F.lit(ANALYZER_ORDER["keyword"]).alias("analyzer_ord"),
        F.lit(0).alias("rule_ord"),
        F.concat(keyword, F.lit(" vulnerability")).alias("name"),
        F.lit(fixed.KEYWORD_CONFIDENCE).alias("confidence"),
        keyword_cwe(keyword).alias("cwe_id"),
        keyword_fix(keyword).alias("fix_suggestion"),
    ]


def _rule_columns() -> list:
    """What a rule finding says, besides its regex's place in the order."""
    return [
        F.concat_ws("-", "rule_id", "file_path", F.col("line_no").cast("string")).alias("finding_id"),
        F.lit("pattern").alias("analyzer"),
        F.lit(ANALYZER_ORDER["pattern"]).alias("analyzer_ord"),
        F.col("rule_ord"), F.col("name"), F.col("confidence"), F.col("cwe_id"),
        fix_text(F.col("fix"), F.col("alternatives"), F.col("language")).alias("fix_suggestion"),
    ]


FINDING_COLUMNS = ["finding_id", "analyzer", "analyzer_ord", "rule_ord", "regex_ord", "name", "description", "severity", "confidence", "file_path",
                   "line_start", "line_end", "code_snippet", "cwe_id", "fix_suggestion", "ai_explanation"]


def _placed(found: DataFrame, columns: list) -> DataFrame:
    return found.select(
        *columns, "file_path", F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"),
        T.strip("line").alias("code_snippet"), F.lit(None).cast("string").alias("ai_explanation")).select(*FINDING_COLUMNS)


def keyword_findings(files: DataFrame) -> DataFrame:
    """Risky calls found by keyword, per language, outside comment lines."""
    lines = explode_lines(files, "file_path", "language")
    lines = lines.filter(~is_comment(F.col("line"), F.col("language")))
    found = lines.withColumn("hit", F.explode(_keyword_hits("language", "line")))
    own = [F.col("hit.keyword_ord").alias("regex_ord"), F.col("hit.risk").alias("description"), F.col("hit.severity").alias("severity")]
    return _placed(found, [*_keyword_columns(F.col("hit.keyword")), *own])


def scanned_findings(files: DataFrame, regexes: list | None = None) -> DataFrame:
    """Findings of rules and of keywords together, in one pass over the lines."""
    lines = explode_lines(files, "file_path", "language").filter(~is_comment(F.col("line"), F.col("language")))
    by_rule = F.when(~T.is_blank("line"), F.expr(regex_hits_sql("line", "language", regexes or fixed.RULE_REGEXES)))
    none = F.lit(None).cast("string")
    hits = F.concat(
        F.transform(F.coalesce(by_rule, F.array()), lambda h: F.struct(
            h["rule_id"].alias("hit_rule"), h["regex_ord"].alias("regex_ord"), none.alias("keyword"), none.alias("risk"), none.alias("risk_severity"))),
        F.transform(F.coalesce(_keyword_hits("language", "line"), F.array()), lambda h: F.struct(
            none.alias("hit_rule"), h["keyword_ord"].alias("regex_ord"), h["keyword"].alias("keyword"), h["risk"].alias("risk"), h["severity"].alias("risk_severity"))))
    found = lines.select("*", F.inline(hits))
    rules = F.broadcast(rule_table(files.sparkSession))  # the rules of the program text
    rated = found.join(rules, F.col("hit_rule") == F.col("rule_id"), "left").withColumn(
        "confidence", match_confidence(F.col("line"), F.col("severity")))
    is_rule = F.col("hit_rule").isNotNull()
    kept = rated.filter(~is_rule | (F.col("confidence") >= F.col("threshold")))

    def either(rule: Column, keyword: Column, name: str) -> Column:
        return F.when(is_rule, rule).otherwise(keyword).alias(name)

    of_keyword = _keyword_columns(F.col("keyword"))
    names = ["finding_id", "analyzer", "analyzer_ord", "rule_ord", "name", "confidence", "cwe_id", "fix_suggestion"]
    columns = [either(r, k, n) for r, k, n in zip(_rule_columns(), of_keyword, names)]
    return _placed(kept, [
        *columns, "regex_ord", either(F.col("description"), F.col("risk"), "description"),
        either(severity_name(F.col("severity")), F.col("risk_severity"), "severity")])


def keyword_cwe(keyword: Column) -> Column:
    return literal_lookup(keyword, fixed.KEYWORD_CWE, fixed.UNKNOWN_CWE)


def keyword_fix(keyword: Column) -> Column:
    return literal_lookup(keyword, fixed.KEYWORD_FIX, fixed.DEFAULT_KEYWORD_FIX)


def union_findings(*parts: DataFrame) -> DataFrame:
    """All analyzers' findings together; an analyzer with nothing to say adds nothing."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


DEDUPE_KEY = ["file_path", "line_start", "name"]


def _arrival(df: DataFrame) -> list:
    return [c for c in ("analyzer_ord", "rule_ord", "regex_ord") if c in df.columns]


def first_per_place(findings: DataFrame) -> DataFrame:
    """Keep the earliest finding per (file, line, name).

    A ``min`` of ordered structs combines on the map side, so a place with very many
    copies costs one row per task instead of one sorted group.
    """
    order = _arrival(findings)
    rest = [c for c in findings.columns if c not in DEDUPE_KEY and c not in order]
    packed = F.struct(*order, *rest)
    kept = findings.groupBy(*DEDUPE_KEY).agg(F.min(packed).alias("kept"))
    return kept.select(*DEDUPE_KEY, "kept.*").select(*findings.columns)


def best_per_place(findings: DataFrame, marker: str = fixed.ENRICHMENT_MARK) -> DataFrame:
    """Keep the most confident finding per (file, line, name).

    Among equals the earliest stays, unless it has an explanation without the
    enrichment marker and a later equal one carries it.
    """
    order = _arrival(findings)
    rest = [c for c in findings.columns if c not in DEDUPE_KEY and c not in order]
    packed = F.struct((-F.col("confidence")).alias("_low"), *order, *rest)
    enriched = F.coalesce(F.contains(F.col("ai_explanation"), F.lit(marker)), F.lit(False))
    kept = findings.groupBy(*DEDUPE_KEY).agg(
        F.min(packed).alias("first"), F.min(F.when(enriched, packed)).alias("enriched")
    )
    plain = F.length("first.ai_explanation") > 0
    unmarked = ~F.contains(F.col("first.ai_explanation"), F.lit(marker))
    take = F.coalesce(plain & unmarked & (F.col("enriched._low") == F.col("first._low")), F.lit(False))
    chosen = kept.withColumn("kept", F.when(take, F.col("enriched")).otherwise(F.col("first")))
    return chosen.select(*DEDUPE_KEY, "kept.*").select(*findings.columns)


def severity_rank(severity: Column) -> Column:
    return literal_lookup(severity, {s: i for i, s in enumerate(fixed.SEVERITY_ORDER)}, len(fixed.SEVERITY_ORDER))
