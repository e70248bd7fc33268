"""Findings from model scores: thresholds, severity ladders and explanations.

The names, descriptions and sentences below are fixed values: they are the text of the results.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import text as T
from ..functions.lookup import literal_lookup
from . import segments as S


def type_cwe(kind: Column) -> Column:
    return literal_lookup(kind, fixed.TYPE_CWE, fixed.UNKNOWN_CWE)


def type_fix(kind: Column) -> Column:
    return literal_lookup(kind, fixed.TYPE_FIX, fixed.DEFAULT_TYPE_FIX)


def percent(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f%%", value * 100.0)


def hybrid_severity(kind: Column, score: Column, confidence: Column) -> Column:
    combined = score * confidence
    critical, high = kind.isin(fixed.CRITICAL_TYPES), kind.isin(fixed.HIGH_TYPES)
    return (
        F.when(critical & (combined > 0.7), "critical")
        .when(critical | (high & (combined > 0.6)), "high")
        .when(combined > 0.5, "medium")
        .otherwise("low")
    )


def graph_severity(kind: Column, probability: Column, trained: bool) -> Column:
    critical, high = kind.isin(fixed.CRITICAL_TYPES), kind.isin(fixed.HIGH_TYPES)
    if not trained:
        return F.when(critical & (probability > 0.9), "high").otherwise("low")
    return (
        F.when(critical & (probability > 0.8), "critical")
        .when(critical | (high & (probability > 0.85)), "high")
        .when(probability > 0.8, "medium")
        .otherwise("low")
    )


def _finding(prefix, kind, severity, confidence, start, end, snippet, explanation, name, description, ordinal):
    return [
        F.concat(F.lit(prefix + "-"), F.col("file_path"), F.lit("-"), F.replace(kind, F.lit(" "), F.lit("_"))).alias("finding_id"),
        F.lit("model").alias("analyzer"), F.lit(3).alias("analyzer_ord"), F.lit(ordinal).alias("rule_ord"),
        F.lit(0).alias("regex_ord"), name.alias("name"), description.alias("description"), severity.alias("severity"),
        confidence.alias("confidence"), F.col("file_path"), start.alias("line_start"), end.alias("line_end"),
        snippet.alias("code_snippet"), type_cwe(kind).alias("cwe_id"), type_fix(kind).alias("fix_suggestion"),
        explanation.alias("ai_explanation"),
    ]


def _structure_finding(finding_id, name, description, severity, confidence, snippet, explanation, ordinal):
    none = F.lit(None).cast("string")
    return [
        finding_id.alias("finding_id"), F.lit("model").alias("analyzer"), F.lit(3).alias("analyzer_ord"),
        F.lit(ordinal).alias("rule_ord"), F.lit(0).alias("regex_ord"), F.lit(name).alias("name"),
        F.lit(description).alias("description"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"),
        F.col("file_path"), F.lit(1).alias("line_start"), T.line_count(F.col("content")).alias("line_end"),
        F.lit(snippet).alias("code_snippet"), none.alias("cwe_id"), none.alias("fix_suggestion"),
        explanation.alias("ai_explanation"),
    ]


def hybrid_findings(scored: DataFrame) -> DataFrame:
    """Findings where the combined model is sure enough, placed at the type's keyword lines."""
    kind, score, sure = F.col("vulnerability_type"), F.col("score"), F.col("type_confidence")
    placed = scored.filter((score > 0.4) & (sure > 0.4)).withColumn("_lines", S.vulnerable_lines(F.col("content"), kind))
    return placed.select(*_finding(
        "HYBRID", kind, hybrid_severity(kind, score, sure), sure,
        F.element_at("_lines", 1), F.element_at("_lines", -1),
        S.context_snippet(F.col("content"), F.col("_lines"), "..."),
        F.lit(None).cast("string"), F.concat(F.lit("Hybrid AI: "), kind),
        F.concat(F.lit("Advanced AI analysis detected "), kind, F.lit(" with high confidence")), 0,
    ))


def dense_code_findings(scored: DataFrame) -> DataFrame:
    dense = scored.filter(F.col("graph_density") > 0.15)
    return dense.select(*_structure_finding(
        F.concat(F.lit("HYBRID-COMPLEXITY-"), F.col("file_path")), "High Code Complexity",
        "AI detected unusually complex code structure that may hide vulnerabilities", "low", 0.7,
        "[Full file - complex structure]", F.format_string("Graph density: %.2f", "graph_density"), 1,
    ))


def graph_findings(scored: DataFrame, trained: bool = True) -> DataFrame:
    """Findings of the structural model; an untrained model counts for much less.

    ``hot`` of a row holds the file's most central lines (``graph.hot_lines``), which the finding spans; without any it
    spans the whole file.
    """
    kind = F.col("vulnerability_type")
    scale = F.lit(1.0) if trained else F.lit(0.3)
    weighed = scored.withColumn("_p", F.col("score") * scale).withColumn("_t", F.col("type_confidence") * scale)
    sure = weighed.filter(F.col("_p") > (0.7 if trained else 0.85))
    located = F.size(F.coalesce("hot", F.array().cast("array<int>"))) > 0
    about = fixed.GRAPH_TRAINED_NOTE if trained else fixed.GRAPH_UNTRAINED_NOTE
    lead = fixed.GRAPH_SURE if trained else fixed.GRAPH_MAYBE
    return sure.select(*_finding(
        "GNN", kind, graph_severity(kind, F.col("_p"), trained), F.col("_p") * F.col("_t"),
        F.when(located, F.element_at("hot", 1)).otherwise(1),
        F.when(located, F.element_at("hot", -1)).otherwise(T.line_count(F.col("content"))),
        F.when(located, S.context_snippet(F.col("content"), F.col("hot"), "")).otherwise(F.lit(fixed.NO_LOCATION)),
        graph_explanation(kind, F.col("_p"), F.col("graph_density"), F.col("suspicious_ratio"), trained),
        F.concat(F.lit("GNN: Structural "), kind, F.lit(" Pattern")),
        F.concat(F.lit(lead), kind, F.lit(". " + about)), 2,
    ))


def suspicious_structure_findings(scored: DataFrame) -> DataFrame:
    odd = scored.filter(F.col("suspicious_ratio") > 0.3)
    return odd.select(*_structure_finding(
        F.concat(F.lit("GNN-COMPLEXITY-"), F.col("file_path")), "Complex/Suspicious Code Structure",
        "Code structure analysis reveals high complexity and suspicious patterns", "medium", 0.75,
        "[Full file analysis]", F.format_string("Suspicious ratio: %.2f", "suspicious_ratio"), 3,
    ))


def graph_explanation(kind, probability, density, ratio, trained: bool) -> Column:
    status = "trained GNN model" if trained else "untrained GNN model (random weights)"
    end = (
        "The GNN identified structural relationships between code elements that match learned vulnerability patterns."
        if trained
        else "Warning: Using untrained model - results may be unreliable. Train the model for accurate detection."
    )
    return F.concat(
        F.lit(f"Graph Neural Network analysis using {status} detected patterns consistent with "), kind,
        F.lit(". Confidence: "), percent(probability, 0), F.lit(". "),
        F.when(density > 0.5, "The code has high structural complexity. ").otherwise(""),
        F.when(ratio > 0.2, F.concat(percent(ratio, 0), F.lit(" of code nodes show suspicious patterns. "))).otherwise(""),
        F.lit(end),
    )


def similarity_explanation(kind, similarity, strong: Column, confidence) -> Column:
    return F.concat(
        F.lit("AI Analysis: This code is "), percent(similarity, 0), F.lit(" similar to a known "), kind,
        F.lit(" vulnerability. "),
        F.when(strong, "The pattern strongly matches known vulnerable code structures. ").otherwise(""),
        F.lit("Confidence level: "), percent(confidence, 0), F.lit(". "),
        F.when(confidence > 0.85, "High probability of vulnerability - immediate review recommended.")
        .when(confidence > 0.75, "Moderate probability - manual review advised.").otherwise(""),
    )


def hybrid_explanation(kind, score, graph_score, text_score, confidence, nodes, edges, dangerous, density) -> Column:
    return F.concat(
        F.lit("Hybrid AI Analysis Results:\n- Detected: "), kind, F.lit(" (Overall: "), percent(score, 1),
        F.lit(", Confidence: "), percent(confidence, 1), F.lit(")\n- GNN (Structure): "), percent(graph_score, 1),
        F.format_string(" - Analyzed %d nodes and %d edges\n- CodeBERT (Semantics): ", nodes, edges),
        percent(text_score, 1), F.lit(" - Code semantically similar to "), kind, F.lit(" patterns\n"),
        F.when(score > 0.8, F.concat(F.lit("\nHIGH RISK: Both structural and semantic analysis indicate "), kind, F.lit(".")))
        .when(score > 0.6, "\nMODERATE RISK: Suspicious patterns detected, manual review recommended.").otherwise(""),
        F.when(dangerous, "\n⚠️ Dangerous functions detected in code.").otherwise(""),
        F.when(density > 0.1, F.format_string("\n\U0001F4CA High code complexity (density: %.2f)", density)).otherwise(""),
    )


def confidence_explanation(kind, overall, methods, factors: dict) -> Column:
    """``methods`` is array<struct<method, score>>; ``factors`` maps a factor to its column."""
    level = (
        F.when(overall > 0.8, F.concat(F.lit("HIGH CONFIDENCE ("), percent(overall, 1), F.lit("): Strong evidence from multiple sources.\n")))
        .when(overall > 0.6, F.concat(F.lit("MODERATE CONFIDENCE ("), percent(overall, 1), F.lit("): Reasonable evidence, manual review recommended.\n")))
        .otherwise(F.concat(F.lit("LOW CONFIDENCE ("), percent(overall, 1), F.lit("): Weak evidence, likely false positive.\n")))
    )
    method_lines = F.array_join(F.transform(methods, lambda m: F.concat(
        F.lit("  • "), F.upper(m["method"]), F.lit(": "), percent(m["score"], 1), F.lit("\n"))), "")
    factor_lines = [
        F.concat(F.lit(f"  • {name.replace('_', ' ').title()}: "), percent(value, 1), F.lit("\n"))
        for name, value in factors.items()
    ]
    warning = F.when(
        factors["context"] < 0.7,
        "\n⚠️ Context suggests lower confidence (test file, comment, or validated input).",
    ).otherwise("")
    return F.concat(F.lit("Confidence Analysis for "), kind, F.lit(":\n"), level, F.lit("\nDetection Methods:\n"),
                    method_lines, F.lit("\nConfidence Factors:\n"), *factor_lines, warning)
