"""Features of a code snippet and how similar two snippets are."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from . import text as T
from .vectors import cosine


def features(code) -> Column:
    return F.struct(
        T.code_tokens(code).alias("tokens"),
        F.length(code).alias("length"),
        T.line_count(code).alias("line_count"),
        T.contains_any(F.lower(code), fixed.FEATURE_INPUT_WORDS).alias("has_user_input"),
        T.contains_any(F.col(code) if isinstance(code, str) else code, fixed.FEATURE_VALIDATION_WORDS).alias("has_validation"),
        T.structure_hash(code).alias("structure_hash"),
    )


def token_set(features: Column) -> Column:
    return F.array_sort(F.array_distinct(features["tokens"]))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays as sets; null when either is empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / union)


def similarity(a: Column, b: Column, vectors: tuple | None = None) -> Column:
    """Mean of token overlap, equal structure, equal flags and (if given) vector cosine."""
    same_hash = F.when(a["structure_hash"] == b["structure_hash"], 1.0).otherwise(0.0)
    same_flags = (
        F.when(a["has_user_input"] == b["has_user_input"], 0.5).otherwise(0.0)
        + F.when(a["has_validation"] == b["has_validation"], 0.5).otherwise(0.0)
    )
    scores = [jaccard(a["tokens"], b["tokens"]), same_hash, same_flags]
    if vectors:
        scores.append(F.when(vectors[0].isNotNull() & vectors[1].isNotNull(), cosine(*vectors)))
    present = F.array_compact(F.array(*scores))
    return F.aggregate(present, F.lit(0.0), lambda acc, s: acc + s) / F.size(present)
