"""Live scanning: messages, debounce, version cache and change-aware findings.

Every step has one definition that runs on a stream and on a table.  Rules are matched in
the JVM before the keyed state, which only compares versions.  Event time is the sender's
clock; a stream drops updates later than its ``lateness``, a parameter.
"""
import difflib
import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import fixed_values as fixed
from ..functions import text as T
from ..functions.lookup import literal_lookup
from ..operators import ordered
from ..operators import scan as C

DEBOUNCE_MS = 300
LATENESS = "10 minutes"
STATE_TTL_MS = 24 * 3600 * 1000

MESSAGE_SCHEMA = "type string, code string, file_path string, language string, client_id string"


def parse_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON messages with defaults; anything that is not a JSON object becomes an error row."""
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(column)).startswith("OBJECT"), F.lit(False))
    m = F.from_json(F.when(is_object, F.col(column)), MESSAGE_SCHEMA)
    rest = [c for c in raw.columns if c != column]
    parsed = raw.select(*rest, is_object.alias("valid"), m.alias("m"))
    return parsed.select(
        *rest, "valid", F.col("m.type").alias("type"),
        F.when(F.col("valid"), F.coalesce("m.code", F.lit(""))).alias("code"),
        F.when(F.col("valid"), F.coalesce("m.file_path", F.lit("untitled"))).alias("file_path"),
        F.when(F.col("valid"), F.coalesce("m.language", F.lit("python"))).alias("language"),
        F.when(~F.col("valid"), F.lit("Invalid JSON format")).alias("error"),
    )


def debounce(updates: DataFrame, gap_ms: int = DEBOUNCE_MS) -> DataFrame:
    """Updates of a table that no newer update of the same file follows within the gap."""
    spaced = ordered.gap_to_next(updates, ["client_id", "file_path"], "ts_ms", "_gap", gap_ms)
    return spaced.filter("_gap IS NULL").drop("_gap")


def debounce_stream(updates: DataFrame, gap_ms: int = DEBOUNCE_MS, lateness: str = LATENESS) -> DataFrame:
    """The same on a stream: the last update of each session of quick updates; of equal times the larger seq."""
    timed = updates.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", lateness)
    sessions = timed.groupBy("client_id", "file_path", F.session_window("ts", f"{gap_ms} milliseconds"))
    last = sessions.agg(F.max_by(F.struct("seq", "ts_ms", "code"), F.struct("ts_ms", "seq")).alias("u"))
    return last.select("client_id", "file_path", "u.seq", "u.ts_ms", "u.code")


def version_changes(updates: DataFrame) -> DataFrame:
    """Each version beside the previous one of its file, and whether it differs."""
    paired = ordered.previous_values(
        updates, ["client_id", "file_path"], "seq", {"previous_code": "code"})
    same = F.md5("previous_code") == F.md5("code")
    return paired.withColumn("changed", ~F.coalesce(same, F.lit(False)))


def added_lines(versions: DataFrame) -> DataFrame:
    """Lines a version has more often than the one before, as a multiset difference."""
    keys = ["client_id", "file_path", "seq"]
    counted = versions.filter("previous_code IS NOT NULL").select(
        *keys, F.explode(F.concat(
            F.transform(T.split_lines("code"), lambda l: F.struct(l.alias("line"), F.lit(1).alias("d"))),
            F.transform(T.split_lines("previous_code"), lambda l: F.struct(l.alias("line"), F.lit(-1).alias("d"))),
        )).alias("e")).select(*keys, "e.line", "e.d")
    extra = counted.groupBy(*keys, "line").agg(F.sum("d").alias("times"))
    return extra.filter("times > 0")


def changed_line_numbers(old: str, new: str) -> list:
    """Line numbers of the new text whose lines are inserted or replace others."""
    matcher = difflib.SequenceMatcher(None, (old or "").split("\n"), (new or "").split("\n"))
    return [n for kind, _, _, first, end in matcher.get_opcodes() if kind in ("insert", "replace") for n in range(first + 1, end + 1)]


def _diff_batch(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([changed_line_numbers(a, b) for a, b in zip(old, new)])


def diff_lines(old: Column, new: Column) -> Column:
    """Changed line numbers of each pair of texts, in Arrow batches."""
    return F.pandas_udf(_diff_batch, "array<int>")(old, new)


def overlapping(findings: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Findings with at least one line among the changed (file, line) rows.

    A finding's short line range is exploded, so the join is an equality on file and line.
    """
    touched = findings.select(key, "file_path", F.explode(F.sequence("line_start", "line_end")).alias("line"))
    hit = touched.join(changed.select("file_path", "line").distinct(), ["file_path", "line"], "left_semi")
    return findings.join(hit.select(key).distinct(), key, "left_semi")


# ------------------------------------------------------------- findings inside one row

def rule_matches(code: str, language: str) -> Column:
    """array<struct<line, rule_id, severity, confidence, threshold>> of a text, in its own row.

    ``code`` and ``language`` are column names.  The rule attributes are literals, so scanning
    a stream needs neither a join nor a shuffle.
    """
    attributes = {r["rule_id"]: r for r in fixed.RULES}

    def lookup(rule_id, field):
        return literal_lookup(rule_id, {k: r[field] for k, r in attributes.items()})

    def skipped(line):
        return C.is_comment(line, F.col(language)) | T.is_blank(line)

    def of_line(found, i):
        ids = F.when(~skipped(found["line"]), F.array_distinct(F.transform(found["hits"], lambda h: h["rule_id"])))
        return F.transform(F.coalesce(ids, F.array()), lambda rule_id: F.struct(
            (i + 1).alias("line"), rule_id.alias("rule_id"), lookup(rule_id, "severity").alias("severity"),
            C.match_confidence(found["line"], lookup(rule_id, "severity")).alias("confidence"),
            lookup(rule_id, "threshold").alias("threshold")))

    hits = C.regex_hits_sql("line", f"`{language}`", fixed.RULE_REGEXES)
    lines = F.expr(f"transform(split(`{code}`, '\\n'), line -> named_struct('line', line, 'hits', {hits}))")
    return F.filter(F.flatten(F.transform(lines, of_line)), lambda f: f["confidence"] >= f["threshold"])


def severity_summary(findings: Column) -> list:
    counts = [F.size(findings).alias("total")]
    for severity in fixed.SEVERITY_ORDER[:4]:
        counts.append(F.size(F.filter(findings, lambda f: f["severity"] == severity)).alias(severity))
    return counts


# ------------------------------------------------------------------------ keyed state

RESULT_SCHEMA = """client_id string, file_path string, seq long, cached boolean, incremental boolean, changed_lines int,
findings array<struct<line:int,rule_id:string,severity:string,confidence:double>>"""
STATE_SCHEMA = "hash string, code string, findings string"


def step(state, code, findings):
    """One update against the state of its file: (new state, cached, incremental, changed, shown).

    The full list of findings is kept in the state, so a finding outside the changed lines
    is not lost when the same text is sent again.
    """
    digest = hashlib.md5(code.encode()).hexdigest()
    if state and state[0] == digest:
        return state, True, False, 0, json.loads(state[2])
    old = state[1] if state else ""
    changed = changed_line_numbers(old, code)
    incremental = len(old) > 0
    shown = [f for f in findings if f["line"] in set(changed)] if changed and incremental else findings
    return (digest, code, json.dumps(findings)), False, incremental, len(changed), shown


#: What leaves the state of a file: one text, as every column of a group costs more than the comparison of its versions.
_RESULTS = f"array<struct<{RESULT_SCHEMA}>>"


def _advance(key, batches, state, expire):
    if state.hasTimedOut:
        state.remove()
        return
    known = state.get if state.exists else None
    updates = [json.loads(u) for batch in batches for u in batch["update"]]  # one micro-batch of one file
    updates.sort(key=lambda u: (u["seq"] is None, u["seq"]))
    out = []
    for u in updates:
        known, cached, incremental, changed, shown = step(known, u["code"], u["findings"])
        out.append({"client_id": key[0], "file_path": key[1], "seq": u["seq"], "cached": cached, "incremental": incremental,
                    "changed_lines": changed, "findings": shown})
    state.update(known)
    if expire:
        state.setTimeoutDuration(STATE_TTL_MS)
    yield pd.DataFrame({"results": [json.dumps(out)]})


def live_scan(updates: DataFrame, expire: bool = True) -> DataFrame:
    """Stream of scan results for a stream of (client_id, file_path, language, seq, code).

    State is one text per open file, dropped after a day without updates.  A wall-clock
    timeout keeps a stream running for ever, so a run that should end passes ``expire=False``.
    The source's ``maxFilesPerTrigger`` or offset limit bounds what one file brings at once.  Rules are matched behind the
    shuffle that the state needs anyway, as a source file of few bytes is one task however many updates it holds.
    """
    parts = int(updates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = updates.select("client_id", "file_path", "language", "seq", "code").repartition(parts, "client_id", "file_path")
    found = F.transform(rule_matches("code", "language"), lambda f: F.struct(*[f[k].alias(k) for k in ("line", "rule_id", "severity", "confidence")]))
    update = F.to_json(F.struct("seq", "code", found.alias("findings")), {"ignoreNullFields": "false"})
    keyed = dealt.select("client_id", "file_path", update.alias("update")).groupBy("client_id", "file_path")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout

    def advance(key, batches, state):
        yield from _advance(key, batches, state, expire)

    results = keyed.applyInPandasWithState(advance, "results string", STATE_SCHEMA, "append", timeout)
    return results.select(F.inline(F.from_json("results", _RESULTS)))


def scan_records(results: DataFrame) -> DataFrame:
    """The record a client receives per update: what was found, how much of each severity, and whether only changes were shown.

    ``results`` are rows of ``live_scan`` or ``incremental_results``; rule texts are literals, so no join is needed.
    """
    rules = {r["rule_id"]: r for r in fixed.RULES}

    def text(rule_id, field):
        return literal_lookup(rule_id, {k: r[field] for k, r in rules.items()})

    shown = F.transform("findings", lambda f: F.struct(
        f["rule_id"].alias("id"), text(f["rule_id"], "name").alias("name"), text(f["rule_id"], "description").alias("description"),
        f["severity"].alias("severity"), f["confidence"].alias("confidence"), f["line"].alias("line_start"), f["line"].alias("line_end"),
        text(f["rule_id"], "fix").alias("fix_suggestion")))
    return results.select(
        "client_id", "file_path", "seq", F.lit("scan_completed").alias("type"), "incremental", shown.alias("vulnerabilities"),
        F.struct(*severity_summary(F.col("findings"))).alias("summary"))


def incremental_results(updates: DataFrame) -> DataFrame:
    """The table form of ``live_scan``: previous versions come from blocked lags, not from state."""
    versions = version_changes(updates).filter("changed")
    versions = ordered.previous_values(
        versions.drop("previous_code", "changed"), ["client_id", "file_path"], "seq", {"previous_code": "code"})
    scanned = versions.withColumn("all", rule_matches("code", "language")).withColumn(
        "lines", diff_lines(F.coalesce("previous_code", F.lit("")), F.col("code")))
    incremental = F.length(F.coalesce("previous_code", F.lit(""))) > 0
    partial = incremental & (F.size("lines") > 0)
    shown = F.when(partial, F.filter("all", lambda f: F.array_contains("lines", f["line"]))).otherwise(F.col("all"))
    return scanned.select(
        "client_id", "file_path", "seq", incremental.alias("incremental"), F.size("lines").alias("changed_lines"), shown.alias("findings"))
