"""Text expressions with the same meaning for every Unicode input.

Spark's ``trim`` only strips blanks and its ``\\w`` is ASCII, so the character classes
are spelled out here once.
"""
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x0b\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD = r"[\p{L}\p{N}_]"


BLANK_CHARACTERS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(column) -> Column:
    return F.btrim(column, F.lit(BLANK_CHARACTERS))


def is_blank(column) -> Column:
    return F.length(strip(column)) == 0


def split_lines(column) -> Column:
    return F.split(column, "\n")


def line_count(column) -> Column:
    return F.length(column) - F.length(F.replace(column, F.lit("\n"), F.lit(""))) + 1


def contains_any(column: Column, words) -> Column:
    """True when any of the words is a substring."""
    return reduce(or_, [column.contains(word) for word in words])


def starts_with_any(column: Column, words) -> Column:
    return reduce(or_, [column.startswith(word) for word in words])


def count_of(column, word: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    removed = F.length(column) - F.length(F.replace(column, F.lit(word), F.lit("")))
    return (removed / len(word)).cast("int")


def cut(column, limit: int | None = None, mark: str = "...") -> Column:
    """The text, or with a limit its first characters and a mark when it is longer."""
    if limit is None:
        return column
    return F.when(F.length(column) > limit, F.concat(F.substring(column, 1, limit), F.lit(mark))).otherwise(column)


def words_present(column: Column, words) -> Column:
    """Array of those words that occur, in list order."""
    marks = F.array(*[F.when(F.contains(column, F.lit(w)), F.lit(w)) for w in words])
    return F.array_compact(marks)


def code_tokens(column, limit: int | None = None) -> Column:
    """Lower-cased words of a snippet, all unless ``limit`` cuts them, after dropping comments and naming strings STRING."""
    text = F.regexp_replace(column, "#[^\n]*", "")
    text = F.regexp_replace(text, "//[^\n]*", "")
    text = F.regexp_replace(text, '"[^"]*"', "STRING")
    text = F.regexp_replace(text, "'[^']*'", "STRING")
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({WORD}+)"), 1)
    return words if limit is None else F.slice(words, 1, limit)


def normalised_code(column) -> Column:
    """Stripped non-blank lines joined again."""
    stripped = F.transform(split_lines(column), strip)
    return F.array_join(F.filter(stripped, lambda l: l != ""), "\n")


def structure_hash(column) -> Column:
    """The whole digest, as it groups and joins."""
    return F.md5(normalised_code(column))


def code_key(language, code) -> Column:
    return F.md5(F.concat_ws(":", language, code))


def finding_key(code, kind, line) -> Column:
    return F.md5(F.concat_ws(":", code, kind, line.cast("string")))


def basename(path) -> Column:
    return F.element_at(F.split(path, "/"), -1)
