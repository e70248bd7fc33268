"""Language of a file from its path or its text."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from .lookup import literal_lookup


def from_extension(path: Column) -> Column:
    """Language for the lower-cased last suffix of the file name; null when unmapped."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"(?s).(\.[^.]+)$", 1))
    return literal_lookup(suffix, fixed.EXTENSION_LANGUAGE)


def from_content(content: Column) -> Column:
    """Language with most signatures present; the earlier language wins a tie."""
    text = F.lower(content)
    scored = []
    for order, (language, signatures) in enumerate(fixed.CONTENT_SIGNATURES.items()):
        score = sum((F.contains(text, F.lit(s.lower())).cast("int") for s in signatures), F.lit(0))
        scored.append(F.struct(score.alias("score"), F.lit(-order).alias("rank"), F.lit(language).alias("language")))
    best = F.array_max(F.array(*scored))
    return F.when(best["score"] > 0, best["language"])


def detect(path: Column, content: Column, head: int | None = None) -> Column:
    """Extension first; else the signatures in the text, or in its head if a length is given."""
    return F.coalesce(from_extension(path), from_content(content if head is None else F.substring(content, 1, head)))


def from_suffix(path: Column, default: str) -> Column:
    ladder = F.lit(default)
    for suffix, language in reversed(fixed.SUFFIX_LANGUAGE):
        ladder = F.when(F.endswith(path, F.lit(suffix)), language).otherwise(ladder)
    return ladder


def display_name(path: Column) -> Column:
    ladder = F.lit(None).cast("string")
    for suffix, name in reversed(fixed.SUFFIX_DISPLAY_NAME):
        ladder = F.when(F.endswith(path, F.lit(suffix)), name).otherwise(ladder)
    return ladder
