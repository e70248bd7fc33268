"""Learned patterns against the sequential definition, and confidence bounds."""
import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import patterns as P
from siftline.functions import scoring as Sc
from siftline.functions import text as T
from siftline.operators import leaders, learning
from siftline.views import feedback


def sequential_leaders(rows):
    """rows: (type, seq, hash, token set) in any order -> {(type, first_seen): confirmations}."""
    found = {}
    for kind, seq, digest, tokens in sorted(rows, key=lambda r: r[1]):
        known = found.setdefault(kind, [])
        for entry in known:
            overlap = tokens and entry[2] and len(tokens & entry[2]) / len(tokens | entry[2]) > 0.7
            if digest == entry[1] or overlap:
                entry[3] += 1
                break
        else:
            known.append([seq, digest, tokens, 1])
    return {(kind, e[0]): e[3] for kind, known in found.items() for e in known}


def described(df):
    cols = df.filter("was_correct").select(
        "vulnerability_type", "seq", T.structure_hash("code_snippet").alias("h"), P.token_set(P.features(F.col("code_snippet"))).alias("t"))
    return [(r[0], r[1], r[2], set(r[3])) for r in cols.collect()]


def random_feedback(spark, seed, n, words, longest):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        if rng.random() < 0.33:
            code = "copy of one very common snippet = value"  # a third of all rows
        else:
            code = " ".join(rng.choice(words) for _ in range(rng.randrange(longest + 1)))
        rows.append((rng.choice("AAB"), seq * 3, rng.random() < 0.9, code))
    return spark.createDataFrame(rows, "vulnerability_type string, seq long, was_correct boolean, code_snippet string")


@pytest.mark.parametrize("seed,words,longest", [(1, "abcdef", 6), (2, "abcdefghijkl", 9), (3, "abc", 4)])
def test_learned_patterns_match_the_sequential_meaning(spark, seed, words, longest):
    df = random_feedback(spark, seed, 150, list(words), longest)
    got = {(r.vulnerability_type, r.first_seen): r.confirmations for r in leaders.learn_patterns(df).collect()}
    assert got == sequential_leaders(described(df))


def test_learned_patterns_on_the_feedback_table(spark, folder):
    df = feedback(spark, folder)
    got = {(r.vulnerability_type, r.first_seen): r.confirmations for r in leaders.learn_patterns(df).collect()}
    assert got == sequential_leaders(described(df))


def test_boost_needs_equal_structure_only(spark):
    """The hash join loses nothing against comparing every pair."""
    df = random_feedback(spark, 9, 80, list("abcd"), 4).cache()
    patterns = learning.patterns_by_structure(df).withColumn("confidence_boost", F.lit(0.1))
    got = {(r[0], r[1]): round(r[2], 9) for r in learning.learned_boost(df, patterns).collect()}
    a = df.select("vulnerability_type", "code_snippet").distinct().withColumn("f", P.features(F.col("code_snippet")))
    b = patterns.withColumn("g", P.features(F.col("code_example"))).withColumnRenamed("vulnerability_type", "kind")
    pairs = a.join(b, F.col("kind") == F.col("vulnerability_type")).withColumn("s", P.similarity(F.col("f"), F.col("g"))).filter("s > 0.8")
    want = {}
    for r in pairs.collect():
        gain = 0.1 * r.s * min(r.confirmations / 10, 2.0)
        key = (r.vulnerability_type, r.code_snippet)
        want[key] = round(max(want.get(key, 0.0), gain), 9)
    assert got == want


def test_scores_stay_in_bounds(spark, folder):
    from siftline.plans import catalog

    row = catalog.QUERIES["confidence_score"](spark, folder).agg(F.min("overall"), F.max("overall"), F.min("context"), F.max("context")).first()
    assert 0 <= row[0] <= row[1] <= 1 and 0 <= row[2] <= row[3] <= 1
    row = catalog.QUERIES["adjust_confidence"](spark, folder).agg(F.min("adjusted_confidence"), F.max("adjusted_confidence")).first()
    assert 0.1 <= row[0] <= row[1] <= 0.99


def test_empty_methods_and_agreement(spark):
    schema = "m array<struct<method:string,score:double>>"
    rows = [([],), ([("pattern", 0.9)],), ([("gnn", 0.9), ("hybrid", 0.85)],), ([("pattern", 0.0), ("ast", 1.0)],)]
    df = spark.createDataFrame(rows, schema)
    got = df.select(Sc.base_confidence(F.col("m")), Sc.agreement(F.col("m")),
                    Sc.reliability(F.col("m"), Sc.base_confidence(F.col("m")), Sc.agreement(F.col("m")))).collect()
    assert [round(r[0], 4) for r in got] == [0.0, 0.9, 0.8736, 0.5333]
    assert [r[1] for r in got] == [0.5, 0.5, 0.95, 0.4]
    assert [r[2] for r in got] == ["low", "medium", "high", "medium"]


def test_feedback_classifier_needs_enough_rows(spark, folder):
    few = feedback(spark, folder).filter("seq < 40")
    assert learning.train_feedback_classifier(few) is None


def test_every_key_keeps_its_row_and_true_figure(spark):
    rows = [("a", True, "gnn")] * 3 + [("b", False, "ast")] * 6 + [("b", True, "ast")] * 6
    df = spark.createDataFrame([(t, k, c, "x = 1", m) for k, (t, c, m) in enumerate(rows)], "vulnerability_type string, seq long, was_correct boolean, code_snippet string, detection_method string")
    got = {r.vulnerability_type: (r.adjustment, r.accuracy, r.total, r.enough) for r in learning.confidence_adjustments(df).collect()}
    assert got == {"a": (1.0, 1.0, 3, False), "b": (1.0, 0.5, 12, True)}
    got = {r.detection_method: (r.measured, r.samples, r.enough) for r in learning.method_accuracy(df).collect()}
    assert got == {"gnn": (1.0, 3, False), "ast": (0.5, 12, True)}
    report = learning.learning_report(df, learning.patterns_by_structure(df)).first()
    assert report.accuracy_improvement == 0 and not report.enough and abs(report.measured_gain - (0.6 - 0.4)) < 1e-9
