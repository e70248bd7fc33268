"""Learning from reviewer feedback: accuracies, adjustments, learned patterns.

Feedback and findings are first reduced to their distinct snippets per type, so a snippet
that makes up a third of all rows is compared once.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import patterns as P
from ..functions import scoring as Sc
from ..functions import text as T
from . import ordered


def _counts(feedback: DataFrame, key: str) -> DataFrame:
    return feedback.groupBy(key).agg(F.count_if("was_correct").alias("correct"), F.count("*").alias("total"))


def type_accuracy(feedback: DataFrame) -> DataFrame:
    counts = _counts(feedback, "vulnerability_type")
    return counts.select("vulnerability_type", (F.col("correct") / F.col("total")).alias("accuracy"), F.col("total").alias("samples"))


def adjustment_factor(accuracy: Column, enough: Column) -> Column:
    """Below half right lowers, above raises; a type without enough feedback stays as it is."""
    return F.when(~enough, 1.0).when(accuracy < 0.5, accuracy + 0.5).otherwise((accuracy - 0.5) * 0.5 + 1.0)


def confidence_adjustments(feedback: DataFrame, minimum: int = 5) -> DataFrame:
    """Every type with its accuracy and factor; ``enough`` tells whether ``minimum`` records back it, else the factor is 1."""
    counts = _counts(feedback, "vulnerability_type").withColumn("enough", F.col("total") >= minimum)
    accuracy = F.col("correct") / F.col("total")
    return counts.select(
        "vulnerability_type", adjustment_factor(accuracy, F.col("enough")).alias("adjustment"), accuracy.alias("accuracy"), "total", "enough")


def method_accuracy(feedback: DataFrame, minimum: int = 10) -> DataFrame:
    """Every method with its ``measured`` accuracy and the one to use: the default where fewer than ``minimum`` records back it."""
    counts = _counts(feedback, "detection_method").withColumn("enough", F.col("total") >= minimum)
    measured = F.col("correct") / F.col("total")
    used = F.when(F.col("enough"), measured).otherwise(fixed.DEFAULT_METHOD_ACCURACY)
    return counts.select("detection_method", used.alias("accuracy"), measured.alias("measured"), F.col("total").alias("samples"), "enough")


def learning_report(feedback: DataFrame, leaders: DataFrame, minimum: int = 20) -> DataFrame:
    """One row: totals, accuracy gain from the first to the last ten records, patterns learned.

    The gain counts as improvement once there are ``minimum`` records (``enough``), before that as 0 beside the measured one.
    """
    totals = feedback.agg(F.count("*").alias("total_feedback"), F.count_if("was_correct").alias("true_positives"))
    hits = F.avg(F.col("was_correct").cast("double"))
    early = feedback.orderBy("seq").limit(10).agg(hits.alias("early"))
    recent = feedback.orderBy(F.col("seq").desc()).limit(10).agg(hits.alias("recent"))
    learned = leaders.agg(F.count("*").alias("patterns_learned"))
    row = totals.select("*", early.scalar().alias("early"), recent.scalar().alias("recent"), learned.scalar().alias("patterns_learned"))
    enough, gain = F.col("total_feedback") >= minimum, F.col("recent") - F.col("early")
    return row.select(
        "total_feedback", "true_positives", (F.col("total_feedback") - F.col("true_positives")).alias("false_positives"),
        F.when(enough, gain).otherwise(0.0).alias("accuracy_improvement"), gain.alias("measured_gain"), enough.alias("enough"), "patterns_learned",
    )


def accuracy_by_batch(feedback: DataFrame, size: int = 5) -> DataFrame:
    """Accuracy of every consecutive batch of ``size`` records in arrival order."""
    numbered = ordered.row_numbers(feedback, [], "seq")
    batch = F.floor((F.col("row_no") - 1) / size).cast("long")
    return numbered.groupBy(batch.alias("batch")).agg(
        F.avg(F.col("was_correct").cast("double")).alias("accuracy"), F.count("*").alias("records"))


def running_accuracy(feedback: DataFrame) -> DataFrame:
    """Accuracy before and after each feedback record."""
    sums = ordered.running_sums(
        feedback.select("seq", "was_correct"), [], "seq",
        {"right": F.col("was_correct").cast("long"), "seen": F.lit(1).cast("long")},
    )
    before_right = F.col("right") - F.col("was_correct").cast("long")
    before_seen = F.col("seen") - 1
    return sums.select(
        "seq",
        F.coalesce(F.try_divide(before_right, before_seen), F.lit(0.0)).alias("accuracy_before"),
        (F.col("right") / F.col("seen")).alias("accuracy_after"),
    )


def ml_performance(scans: DataFrame, findings: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row per type, with or without enough feedback: derived accuracy beside the overall totals."""
    adjusted = confidence_adjustments(feedback)
    totals = feedback.agg(F.struct(F.count("*").alias("all"), F.count_if("was_correct").alias("right")).alias("t"))
    row = adjusted.select(
        "*", scans.agg(F.count("*")).scalar().alias("total_scans"), findings.agg(F.count("*")).scalar().alias("total_detections"),
        totals.scalar().alias("t")).select("*", F.col("t.all").alias("total_feedback"), F.col("t.right").alias("true_positives"))
    return row.select(
        "vulnerability_type", "enough", F.least(F.col("adjustment") * 0.7, F.lit(0.95)).alias("type_accuracy"),
        "total_scans", "total_detections", "true_positives",
        (F.col("total_feedback") - F.col("true_positives")).alias("false_positives"),
        (F.col("true_positives") / F.greatest(F.col("total_feedback"), F.lit(1))).alias("accuracy"),
    )


def time_decay(latest: Column, as_of: Column) -> Column:
    """Weight of feedback by the age in whole days of its latest record."""
    days = F.floor(F.timestamp_diff("SECOND", latest, as_of) / 86400)
    return (
        F.when(latest.isNull(), 1.0).when(days < 7, 1.0).when(days < 30, 0.95).when(days < 90, 0.9).otherwise(0.8)
    )


# ---------------------------------------------------------------------------- patterns

def distinct_snippets(feedback: DataFrame) -> DataFrame:
    """One row per (type, token set, structure): first arrival, count and first example."""
    described = feedback.select(
        "vulnerability_type", "seq", "code_snippet", P.features(F.col("code_snippet")).alias("f"))
    return described.groupBy(
        "vulnerability_type", F.col("f.structure_hash").alias("structure_hash"), P.token_set(F.col("f")).alias("tokens")
    ).agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("arrivals"),
        F.min_by("code_snippet", "seq").alias("code_example"),
    )


def patterns_by_structure(feedback: DataFrame) -> DataFrame:
    """Cheap variant: confirmed snippets of equal structure are one pattern."""
    confirmed = feedback.filter("was_correct")
    return confirmed.groupBy("vulnerability_type", T.structure_hash("code_snippet").alias("structure_hash")).agg(
        F.count("*").alias("confirmations"), F.min("seq").alias("first_seen"), F.max("seq").alias("last_seen"),
        F.min_by("code_snippet", "seq").alias("code_example"),
    )


def false_positive_patterns(feedback: DataFrame) -> DataFrame:
    """Every false positive is kept as a penalising pattern, one row per distinct snippet."""
    wrong = feedback.filter(~F.col("was_correct"))
    return wrong.groupBy("vulnerability_type", "code_snippet").agg(
        F.count("*").alias("records"), F.lit(-0.2).alias("confidence_penalty"))


def _compare(findings: DataFrame, patterns: DataFrame, over: float, gain: Column, best) -> DataFrame:
    """Best gain per distinct (type, snippet) of the findings against patterns of the type.

    The similarity is a mean of at most four scores of at most 1, so it can only pass 0.75
    when the structure is equal: the structure hash joins exactly, without all pairs.
    """
    if over <= 0.75:
        raise ValueError("equal structure is only implied above 0.75")
    wanted = findings.select("vulnerability_type", "code_snippet").distinct()
    wanted = wanted.withColumn("f", P.features(F.col("code_snippet"))).withColumn("structure_hash", F.col("f.structure_hash"))
    known = patterns.select(
        "vulnerability_type", P.features(F.col("code_example")).alias("g"), *[c for c in patterns.columns if c.startswith("confi")])
    known = known.withColumn("structure_hash", F.col("g.structure_hash"))
    pairs = wanted.join(known, ["vulnerability_type", "structure_hash"])
    pairs = pairs.withColumn("similarity", P.similarity(F.col("f"), F.col("g"))).filter(F.col("similarity") > over)
    return pairs.groupBy("vulnerability_type", "code_snippet").agg(best(gain).alias("gain"))


def learned_boost(findings: DataFrame, patterns: DataFrame) -> DataFrame:
    """(type, snippet, boost) from confirmed patterns; more confirmations weigh more."""
    gain = F.col("confidence_boost") * F.col("similarity") * F.least(F.col("confirmations") / 10, F.lit(2.0))
    return _compare(findings, patterns, 0.8, gain, F.max).withColumnRenamed("gain", "boost")


def false_positive_penalty(findings: DataFrame, patterns: DataFrame) -> DataFrame:
    """(type, snippet, penalty) from snippets known to be false positives."""
    gain = F.col("confidence_penalty") * F.col("similarity")
    renamed = patterns.withColumnRenamed("code_snippet", "code_example")
    return _compare(findings, renamed, 0.85, gain, F.min).withColumnRenamed("gain", "penalty")


def adjust_confidence(findings: DataFrame, feedback: DataFrame, learned: DataFrame, as_of: Column) -> DataFrame:
    """Confidence after type factor, boosts, penalties, method reliability and time decay.

    ``findings`` needs vulnerability_type, code_snippet, confidence and detector_id.
    """
    boost = learned_boost(findings, learned)
    penalty = false_positive_penalty(findings, false_positive_patterns(feedback))
    per_snippet = boost.join(penalty, ["vulnerability_type", "code_snippet"], "full")
    factors = confidence_adjustments(feedback).select("vulnerability_type", "adjustment")
    weak = method_accuracy(feedback).filter(F.col("accuracy") < 0.7).agg(F.collect_set("detection_method").alias("weak"))
    decay = feedback.agg(time_decay(F.max("feedback_ts"), as_of).alias("decay"))
    joined = (
        findings.join(factors, "vulnerability_type", "left")
        .join(per_snippet, ["vulnerability_type", "code_snippet"], "left")
        .select("*", weak.scalar().alias("weak"), decay.scalar().alias("decay"))
    )
    raw = F.col("confidence") * F.coalesce("adjustment", F.lit(1.0))
    raw = raw + F.coalesce("boost", F.lit(0.0)) + F.coalesce("penalty", F.lit(0.0))
    n_weak = F.size(F.array_intersect(Sc.learning_methods(F.col("detector_id")), F.col("weak")))
    adjusted = Sc.clamp(raw * F.pow(F.lit(0.9), n_weak) * F.col("decay"), 0.1, 0.99)
    reason = (
        F.when(adjusted > F.col("confidence"), "Boosted due to similarity with confirmed patterns")
        .when(adjusted < F.col("confidence"), "Reduced due to similarity with false positive patterns")
        .otherwise("No adjustment needed")
    )
    return joined.select(*findings.columns, adjusted.alias("adjusted_confidence"), reason.alias("adjustment_reason"))


def pattern_suggestions(patterns: DataFrame, limit: int = 10) -> DataFrame:
    """Best confirmed patterns to turn into rules."""
    good = patterns.filter(
        (F.col("confirmations") >= 3) & ~F.startswith("vulnerability_type", F.lit(fixed.FALSE_POSITIVE_PREFIX)))
    return good.orderBy(F.col("confirmations").desc(), "vulnerability_type", "first_seen").limit(limit)


def approve_suggestion(suggestions: DataFrame, index: int) -> DataFrame:
    """The suggestion at a 0-based position as a new rule."""
    # the suggestions are at most ten rows, so offset and limit stay tiny
    order = [F.col("confirmations").desc(), "vulnerability_type", "first_seen"]
    picked = suggestions.orderBy(*order).offset(index).limit(1)
    pattern = F.array(F.col("code_example"))
    return picked.select(
        F.concat(F.lit("LEARNED-"), F.md5(F.concat_ws("|", "vulnerability_type", "code_example"))).alias("rule_id"),
        F.concat(F.lit("Learned "), "vulnerability_type", F.lit(" Pattern")).alias("name"),
        F.concat(F.lit("Pattern learned from "), F.col("confirmations").cast("string"), F.lit(" confirmed detections")).alias("description"),
        F.lit("high").alias("severity"),
        F.array(F.lit("python"), F.lit("javascript")).alias("languages"),
        F.create_map(F.lit("python"), pattern, F.lit("javascript"), pattern).alias("detection_patterns"),
        (F.col("confidence_boost") + 0.7).alias("threshold"),
        F.lit(fixed.LEARNED_RULE_FIX).alias("fix"),
    )


def classifier_features(feedback: DataFrame) -> DataFrame:
    code = F.col("code_snippet")
    return feedback.select(
        "seq", F.length(code).alias("length"), (T.line_count(code) - 1).alias("newlines"),
        *[F.contains(code, F.lit(w)).cast("int").alias(f"has_{w.lower()}") for w in fixed.CLASSIFIER_WORDS],
        "original_confidence", F.col("was_correct").cast("int").alias("label"),
    )


def train_feedback_classifier(feedback: DataFrame, recent: int = 500, folds: int = 5, trees: int = 100):
    """Random forest on the latest records with cross-validated accuracy; None when too few.

    The window of ``recent`` rows is the feature itself, so training data is bounded.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rows = classifier_features(feedback.orderBy(F.col("seq").desc()).limit(recent))
    columns = [c for c in rows.columns if c not in ("seq", "label")]
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(rows).select("features", "label").cache()
    if data.count() <= 50:
        return None
    forest = RandomForestClassifier(numTrees=trees, seed=42, labelCol="label", featuresCol="features")
    check = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    search = CrossValidator(
        estimator=forest, estimatorParamMaps=ParamGridBuilder().build(), evaluator=check, numFolds=folds, seed=42, parallelism=4)
    fitted = search.fit(data)
    data.unpersist()
    return fitted.bestModel, fitted.avgMetrics[0]
