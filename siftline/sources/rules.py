"""The rule knowledge base as a table, and its load-time checks."""
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.lookup import literal_rows

# ASCII-only defaults of Java regexes are switched off: letters, digits and blanks mean
# the Unicode ones, case folds likewise, and only '\n' ends a line.
REGEX_FLAGS = "(?idU)"

RULE_COLUMNS = ["rule_id", "name", "description", "severity", "cwe_id", "owasp", "threshold",
                "false_positive_rate", "fix", "reference"]


def rule_table(spark: SparkSession) -> DataFrame:
    """One row per rule with its languages and per-language alternatives (8 rows)."""
    rows = [
        [order, *[rule[c] for c in RULE_COLUMNS], rule["languages"], rule["alternatives"]]
        for order, rule in enumerate(fixed.RULES)
    ]
    return literal_rows(spark, ["rule_ord", *RULE_COLUMNS, "languages", "alternatives"], rows)


def regex_table(spark: SparkSession) -> DataFrame:
    """One row per (rule, language, regex) in knowledge-base order (69 rows)."""
    return literal_rows(
        spark, ["regex_ord", "rule_id", "language", "regex"],
        [[i, rule, language, normalise_regex(regex)] for i, (rule, language, regex) in enumerate(fixed.RULE_REGEXES)],
    )


def normalise_regex(regex: str) -> str:
    """Doubled backslashes before parentheses become single ones."""
    return re.sub(r"\\\\(?=[()])", lambda _: "\\", regex)


_CONSUMED = re.compile(
    r"\[\^?\]?(?:\\.|[^\]\\])*\][*+?]*"  # character class
    r"|\((?:\?:)?[\w|]*\)"  # choice of words
    r"|\\[sbwdSBWD][*+?]*"  # class escape
    r"|\.[*+]\??"  # any text
    r"|(?<!\\)\$$"  # end of line
)


def required_text(regex: str) -> str:
    """The longest literal every match of a simple regex contains, in lower case; '' when unsure.

    A line without it cannot match, which a plain substring test finds out far faster.
    """
    runs = []
    for piece in _CONSUMED.split(regex):
        plain = re.sub(r"\\\W", "", piece)
        if re.search(r"[\\|?*+(){}^$.\[\]]", plain):
            return ""
        runs.append(re.sub(r"\\(\W)", r"\1", piece))
    return max(runs, key=len).lower()


def usable_rules(spark: SparkSession, rules: list) -> list:
    """Replace rules whose regex Java rejects by their fallback, dropping those without one.

    ``rules`` holds (rule_id, language, regex); the result adds an ``is_fallback`` flag.
    Every regex is probed once on a one-row frame when the knowledge base is loaded.
    """
    usable = []
    for rule_id, language, regex in rules:
        regex = normalise_regex(regex)
        if _accepted(spark, regex):
            usable.append((rule_id, language, regex, False))
            continue
        for marker, needs_boundary, fallback_id, *_, fallback_regex in fixed.FALLBACK_RULES:
            if marker in regex and (not needs_boundary or "\\b" in regex):
                usable.append((fallback_id, language, fallback_regex, True))
                break
    return usable


def _accepted(spark: SparkSession, regex: str) -> bool:
    try:
        spark.range(1).select(F.lit("").rlike(REGEX_FLAGS + regex)).collect()
        return True
    except Exception:
        return False


def save_rules(rules: DataFrame, path: str) -> None:
    """Seeding replaces the whole stored knowledge base."""
    rules.coalesce(1).write.mode("overwrite").parquet(path)


def search_rules(rules: DataFrame, language=None, severity=None) -> DataFrame:
    """Rules for a language and/or severity; no argument means no filter."""
    if language:
        rules = rules.filter(F.array_contains("languages", language))
    if severity:
        rules = rules.filter(F.col("severity") == severity)
    return rules
