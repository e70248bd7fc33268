"""Confidence arithmetic over method scores and code context."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from . import text as T
from .lookup import literal_lookup


def method_scores(finding_id: Column, confidence: Column) -> Column:
    """array<struct<method, score>> read off the marks in a finding id."""
    def when(marks, method):
        return F.when(T.contains_any(finding_id, marks), F.struct(F.lit(method).alias("method"), confidence.alias("score")))
    found = F.array_compact(F.array(
        when(["PATTERN", "PARSE"], "pattern"), when(["AST", "PARSE"], "ast"), when(["AI-"], "codebert"),
        when(["GNN"], "gnn"), when(["HYBRID"], "hybrid"),
    ))
    unknown = F.array(F.struct(F.lit("unknown").alias("method"), confidence.alias("score")))
    return F.when(F.size(found) > 0, found).otherwise(unknown)


def learning_methods(finding_id: Column) -> Column:
    """array<string> of methods as the feedback loop names them."""
    def when(marks, method):
        return F.when(T.contains_any(finding_id, marks), F.lit(method))
    found = F.array_compact(F.array(
        when(["PATTERN"], "pattern"), when(["AST", "PARSE"], "ast"), when(["AI-"], "ai"), when(["GNN"], "gnn"),
        when(["HYBRID"], "hybrid"),
    ))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def base_confidence(methods: Column) -> Column:
    """Mean of the scores weighted by method; 0 without methods."""
    def weight(m):
        return literal_lookup(m["method"], fixed.METHOD_WEIGHTS, fixed.OTHER_METHOD_WEIGHT)
    weighted = _total(F.transform(methods, lambda m: m["score"] * weight(m)))
    return F.coalesce(F.try_divide(weighted, _total(F.transform(methods, weight))), F.lit(0.0))


def agreement(methods: Column) -> Column:
    """How well several methods agree, by the population variance of their scores."""
    n = F.size(methods)
    mean = F.try_divide(_total(F.transform(methods, lambda m: m["score"])), n)
    squares = _total(F.transform(methods, lambda m: (m["score"] - mean) * (m["score"] - mean)))
    variance = F.try_divide(squares, n)
    return (
        F.when(n < 2, 0.5).when(variance < 0.05, 0.95).when(variance < 0.1, 0.8).when(variance < 0.2, 0.6).otherwise(0.4)
    )


def context_score(path: Column, in_comment, has_user_input, has_validation, function_name) -> Column:
    m = fixed.CONTEXT_MODIFIERS
    score = F.lit(1.0)
    for test, name in [
        (T.contains_any(F.lower(path), fixed.TEST_PATH_MARKS), "test_file"),
        (in_comment, "comment"),
        (has_user_input, "user_input"),
        (has_validation, "validation"),
        (T.contains_any(F.lower(function_name), fixed.SECURITY_FUNCTION_WORDS), "security_function"),
    ]:
        score = score + F.when(test, m[name]).otherwise(0.0)
    return clamp(score, 0.0, 1.0)


def complexity_score(complexity: Column) -> Column:
    return F.when(complexity > 10, 0.7).when(complexity > 5, 0.85).otherwise(1.0)


def overall_confidence(factors: dict) -> Column:
    total = F.lit(0.0)
    for name, weight in fixed.FACTOR_WEIGHTS.items():
        total = total + factors[name] * weight
    return clamp(total, 0.0, 1.0)


def reliability(methods: Column, base: Column, validation: Column) -> Column:
    ai = F.filter(methods, lambda m: m["method"].isin(fixed.AI_METHODS))
    strong_ai = (F.size(ai) >= 2) & F.forall(ai, lambda m: m["score"] > 0.8)
    return (
        F.when(strong_ai, "high").when((validation > 0.7) & (base > 0.7), "high").when(base > 0.5, "medium").otherwise("low")
    )


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
