"""Analyzers as functions from files to findings, run side by side."""
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from . import scan as C

CUSTOM_FINDING = """finding_id string, name string, description string, severity string, confidence double, file_path string,
line_start int, line_end int, code_snippet string, cwe_id string, fix_suggestion string"""
COLUMNS = [c.strip().split()[0] for c in CUSTOM_FINDING.split(",")]


def failure(error: Exception, path: str | None = None) -> dict:
    """The finding that stands for a failed analysis."""
    return {
        "finding_id": f"ANALYZER-ERROR-{path or 'plan'}", "name": "Analyzer error", "severity": "info", "confidence": 0.0,
        "description": f"{type(error).__name__}: {error}", "file_path": path}


def run_analyzers(files: DataFrame, analyzers: list | None = None) -> DataFrame:
    """Union of the analyzers' findings on the languages each one supports.

    ``analyzers`` holds (function, languages or None), the built-in ones by default.  One that cannot even be
    planned contributes an error finding.
    """
    parts = []
    for order, (analyze, languages) in enumerate(BUILT_IN if analyzers is None else analyzers):
        own = files.filter(F.col("language").isin(languages)) if languages else files
        try:
            found = analyze(own)
            found.schema  # planning errors surface here
        except Exception as error:
            row = {**dict.fromkeys(COLUMNS), **failure(error)}
            found = files.sparkSession.createDataFrame([tuple(row[c] for c in COLUMNS)], CUSTOM_FINDING)
        parts.append(found.withColumn("analyzer_ord", F.lit(order)))
    return C.union_findings(*parts)


def python_analyzer(analyze):
    """An analyzer from a Python function ``(code, language, file_path) -> list of dicts``.

    Files stream through it in Arrow batches; a file on which it fails yields an error finding.
    """

    def run(batches):
        for batch in batches:
            found = []
            for code, language, path in zip(batch["content"], batch["language"], batch["file_path"]):
                try:
                    found += [{**dict.fromkeys(COLUMNS), **f, "file_path": path} for f in analyze(code, language, path)]
                except Exception as error:
                    found.append({**dict.fromkeys(COLUMNS), **failure(error, path)})
            yield pd.DataFrame(found, columns=COLUMNS)

    def build(files: DataFrame) -> DataFrame:
        return files.select("content", "language", "file_path").mapInPandas(run, CUSTOM_FINDING)

    build.__name__ = getattr(analyze, "__name__", "analyzer")
    return build


BUILT_IN = [
    (C.rule_findings, fixed.SUPPORTED_LANGUAGES),
    (C.keyword_findings, fixed.SUPPORTED_LANGUAGES),
]
