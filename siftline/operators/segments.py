"""Cutting files into blocks and describing the pieces.

A file is one row, so its lines are handled as an array inside that row: no explode, no
window, no shuffle, and the cost is linear in the text.
"""
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import text as T
from ..functions.lookup import let


def _starts(lines: Column) -> Column:
    """1-based positions of lines that open a function or member."""
    return F.array_compact(
        F.transform(lines, lambda line, i: F.when(T.contains_any(line, fixed.BLOCK_STARTS), i + 1))
    )


def _pieces(lines: Column, starts: Column) -> Column:
    """(start_line, body) from every start to the line before the next one."""
    return F.transform(
        starts,
        lambda s, k: F.struct(
            s.alias("start_line"),
            F.slice(lines, s, F.coalesce(F.get(starts, k + 1), F.size(lines) + 1) - s).alias("body"),
        ),
    )


def _prepared(files: DataFrame) -> DataFrame:
    pieces = let(T.split_lines("content"), lambda lines: let(_starts(lines), lambda starts: _pieces(lines, starts)))
    return files.withColumn("_pieces", pieces)


def function_blocks(files: DataFrame, *keep: str) -> DataFrame:
    """Blocks for similarity analysis.

    A block ends at the first blank line that is at least its fourth line, or before the
    next start; a file without any start is one block.
    """
    keep = keep or ("file_id", "language")

    def close(piece):
        ends = F.transform(piece["body"], lambda line, j: F.when((j >= 3) & T.is_blank(line), j + 1))
        size = F.coalesce(F.array_min(F.array_compact(ends)), F.size(piece["body"]))
        return let(size, lambda n: F.struct(
            piece["start_line"].alias("start_line"), n.alias("line_count"),
            F.array_join(F.slice(piece["body"], 1, n), "\n").alias("code")))

    whole = F.array(F.struct(
        F.lit(1).alias("start_line"), T.line_count("content").alias("line_count"), F.col("content").alias("code")))
    blocks = F.when(F.size("_pieces") > 0, F.transform("_pieces", close)).otherwise(whole)
    return _prepared(files).select(*keep, F.inline(blocks))


def function_segments(files: DataFrame, *keep: str) -> DataFrame:
    """Segments for anomaly analysis: from each start to the next start."""
    keep = keep or ("file_id", "language")
    segments = F.transform("_pieces", lambda p: F.struct(
        p["start_line"].alias("start_line"), F.array_join(p["body"], "\n").alias("code"), F.lit("function").alias("type")))
    return _prepared(files).select(*keep, F.inline(segments))


SEGMENT_SCHEMA = "array<struct<start_line:int,code:string,type:string>>"


def multiline_segments(files: DataFrame, *keep: str) -> DataFrame:
    """Suspicious multi-line passages over the whole text of each file.

    Positions of regex matches with back references have no built-in form, so an Arrow
    UDF runs ``finditer`` on each text.
    """
    keep = keep or ("file_id", "language")
    patterns = [(re.compile(p, re.MULTILINE | re.IGNORECASE), kind) for p, kind in fixed.SUSPICIOUS_SEGMENTS]

    @F.pandas_udf(SEGMENT_SCHEMA)
    def find(texts: pd.Series) -> pd.Series:
        def one(text):
            found = []
            for pattern, kind in patterns:
                line, at = 1, 0
                for match in pattern.finditer(text or ""):
                    line += text.count("\n", at, match.start())
                    at = match.start()
                    found.append({"start_line": line, "code": match.group(0), "type": kind})
            return found
        return texts.map(one)

    return files.select(*keep, F.inline(find("content")))


def block_complexity(code: Column) -> Column:
    words = "|".join(fixed.BLOCK_DECISION_WORDS)
    return F.regexp_count(code, F.lit(rf"(?U)\b({words})\b")) + 1


def complexity_findings(files: DataFrame, limit: int = fixed.COMPLEXITY_LIMIT) -> DataFrame:
    """Low-severity findings for blocks with too many decisions."""
    blocks = function_blocks(files, "file_path").withColumn("complexity", block_complexity(F.col("code")))
    called = F.regexp_extract("code", f"({T.WORD}+)\\s*\\(", 1)
    name = F.when(called != "", called).otherwise("block")
    over = blocks.filter(F.col("complexity") > limit)
    return over.select(
        F.concat(F.lit("COMPLEX-"), name, F.lit("-"), F.col("start_line").cast("string")).alias("finding_id"),
        F.lit("complexity").alias("analyzer"),
        F.lit(2).alias("analyzer_ord"), F.lit(0).alias("rule_ord"), F.lit(0).alias("regex_ord"),
        F.concat(F.lit("High complexity in "), name).alias("name"),
        F.concat(F.lit("Function has cyclomatic complexity of "), F.col("complexity").cast("string")).alias("description"),
        F.lit("low").alias("severity"),
        F.lit(0.95).alias("confidence"),
        "file_path",
        F.col("start_line").alias("line_start"),
        (F.col("start_line") + F.col("line_count") - 1).alias("line_end"),
        F.col("code").alias("code_snippet"),
        F.lit(None).cast("string").alias("cwe_id"),
        F.lit(fixed.COMPLEXITY_FIX).alias("fix_suggestion"),
        F.lit(None).cast("string").alias("ai_explanation"),
    )


def keyword_complexity(code: Column) -> Column:
    total = F.lit(1)
    for word in fixed.COMPLEXITY_WORDS:
        total = total + T.count_of(code, word)
    return total


def labelled_lines(code: Column) -> Column:
    """Line numbers that carry a known dangerous call; call names are literal text."""
    def hit(line):
        return T.contains_any(line, fixed.LABELLED_LINE_LITERALS) | line.rlike(fixed.LABELLED_LINE_REGEX)
    return F.array_compact(F.transform(T.split_lines(code), lambda line, i: F.when(hit(line), i + 1)))


def vulnerable_lines(code: Column, kind: Column) -> Column:
    """Line numbers that hold a keyword of the vulnerability type; the first line if none does."""
    lines = T.split_lines(code)
    found = F.lit(None).cast("array<int>")
    for name, words in fixed.TYPE_LINE_KEYWORDS.items():
        found = F.when(kind == name, _lines_with(lines, words)).otherwise(found)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(1)))


def _lines_with(lines: Column, words) -> Column:
    return F.array_compact(F.transform(lines, lambda line, i: F.when(T.contains_any(line, words), i + 1)))


def context_snippet(code: Column, lines: Column, mark: str, around: int = 2, limit: int | None = None) -> Column:
    """The text, whole or cut to a limit, from ``around`` lines before the first hit to as many after the last."""
    all_lines = T.split_lines(code)
    low = F.greatest(F.lit(0), F.array_min(lines) - around - 1)
    high = F.least(F.size(all_lines), F.array_max(lines) + around)
    return T.cut(F.array_join(F.slice(all_lines, low + 1, high - low), "\n"), limit, mark)


def code_context(code: Column) -> dict:
    return {
        "lines_of_code": T.line_count(code),
        "has_user_input": T.contains_any(F.lower(code), fixed.CONTEXT_INPUT_WORDS),
        "has_validation": T.contains_any(code, fixed.CONTEXT_VALIDATION_WORDS),
        "has_error_handling": T.contains_any(code, fixed.CONTEXT_ERROR_WORDS),
    }


def file_flags(code: Column) -> dict:
    return {
        "code_lines": T.line_count(code),
        "has_user_input": T.contains_any(F.lower(code), fixed.FEATURE_INPUT_WORDS),
        "has_dangerous_functions": T.contains_any(code, fixed.DANGEROUS_WORDS),
        "has_sql_keywords": T.contains_any(F.upper(code), fixed.SQL_WORDS),
    }


def risk_tier(code: Column) -> Column:
    lower = F.lower(code)
    ladder = F.lit(fixed.LOW_RISK_TEXT)
    for level, words in reversed(fixed.RISK_WORDS):
        ladder = F.when(T.contains_any(lower, words), f"{level}: {fixed.RISK_TEXT}").otherwise(ladder)
    return ladder


def predicted_cwe(code: Column) -> Column:
    lower = F.lower(code)
    ladder = F.lit(None).cast("string")
    for cwe, words in reversed(fixed.CWE_WORDS):
        ladder = F.when(T.contains_any(lower, words), cwe).otherwise(ladder)
    return ladder


def segment_statistics(code: Column) -> dict:
    """Length, newlines, distinct words, brackets and '#' lines of a segment, with five flags."""
    words = F.filter(F.split(code, f"{T.BLANK}+"), lambda w: w != "")
    plain = F.translate(code, "()[]{}", "")
    hash_lines = F.filter(T.split_lines(code), lambda l: F.startswith(T.strip(l), F.lit("#")))
    features = {
        "length": F.length(code),
        "newlines": T.line_count(code) - 1,
        "distinct_words": F.size(F.array_distinct(words)),
        "brackets": F.length(code) - F.length(plain),
        "hash_lines": F.size(hash_lines),
    }
    for name, flag_words, folded in fixed.SEGMENT_FLAG_WORDS:
        features[name] = T.contains_any(F.lower(code) if folded else code, flag_words)
    return features
