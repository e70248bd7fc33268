"""Labelled data: classes, variants, balance and split, training on pooled graph features."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.lookup import literal_lookup
from ..session import unfolded
from . import ordered


def cwe_type(cwe: Column) -> Column:
    return literal_lookup(cwe, fixed.CWE_TYPE)


def cwe_class(cwe: Column) -> Column:
    return literal_lookup(cwe, fixed.CWE_CLASS, fixed.OTHER_CLASS)


def code_variant(code: Column, variant: Column) -> Column:
    """The code with its telling identifiers renamed; variant 0 is the code itself."""
    changed = code
    for old, new in fixed.VARIANT_RENAMES:
        changed = F.replace(changed, F.lit(old), F.concat(F.lit(new), variant.cast("string")))
    return F.when(variant == 0, code).otherwise(changed)


def code_variants(samples: DataFrame, variants: int = 3) -> DataFrame:
    """Every sample in each of its variants, made in place without a join."""
    numbers = F.explode(F.array(*[F.lit(v) for v in range(variants)]))
    spread = samples.withColumn("variant", numbers)
    return spread.withColumn("code", code_variant(F.col("code"), F.col("variant"))).withColumn(
        "file_id", F.concat(F.col("file_id").cast("string"), F.lit("-v"), F.col("variant").cast("string")))


#: Samples carry whole texts through their numbering, so fewer of them share a window.
SPLIT_BLOCK = 1 << 14


def balanced_split(samples: DataFrame, seq: str = "file_id", train_share: float = 0.8, block: int = SPLIT_BLOCK) -> DataFrame:
    """Both classes cut to the smaller one, the first four fifths of each for training.

    Positions come from row numbers in blocks of ``block`` ids, so no class is sorted in one task.
    """
    sizes = samples.groupBy("label").agg(F.count("*").alias("n"))
    # two rows, one per class
    kept = sizes.agg(F.when(F.count("*") == 2, F.min("n")).otherwise(0).alias("kept"))
    numbered = ordered.row_numbers(samples, ["label"], seq, block=block).select("*", kept.scalar().alias("kept"))
    chosen = numbered.filter(F.col("row_no") <= F.col("kept"))
    part = F.when(F.col("row_no") <= F.floor(F.col("kept") * train_share), "train").otherwise("test")
    return chosen.withColumn("split", part).drop("row_no", "kept")


def dataset_metadata(samples: DataFrame) -> DataFrame:
    return samples.groupBy("split").agg(
        F.count("*").alias("total_samples"), F.count_if(F.col("label") == 1).alias("vulnerable_samples"),
        F.array_join(F.sort_array(F.collect_set("cwe_id")), ",").alias("cwe_types"),
        F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"))


def save_dataset(samples: DataFrame, path: str) -> None:
    """Train and test parts as JSON folders beside their metadata."""
    samples.write.mode("overwrite").partitionBy("split").json(f"{path}/samples")
    dataset_metadata(samples).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def tfidf(texts: DataFrame, id_column: str = "file_id", column: str = "content") -> DataFrame:
    """(id, word, weight) of every word: its count in the text times ln((texts + 1) / (texts with it + 1))."""
    total = texts.agg(F.count("*")).scalar()
    words = texts.select(id_column, F.explode(F.regexp_extract_all(F.lower(column), F.lit(r"([\p{L}\p{N}_]+)"), 1)).alias("word"))
    counts = words.groupBy(id_column, "word").agg(F.count("*").alias("n"))
    held = counts.groupBy("word").agg(F.count("*").alias("texts"))
    # the vocabulary grows with the texts; a word of most texts meets its one row of ``held``; adaptive execution splits it
    weight = F.col("n") * F.log((total + 1.0) / (F.col("texts") + 1.0))
    return counts.join(unfolded(held), "word").select(id_column, "word", weight.alias("weight"))


def train_graph_classifier(pooled: DataFrame, positive_weight: float = 2.0, seed: int = 42):
    """Vulnerable-or-safe and type models on pooled graph features.

    ``pooled`` has features (array<double>), label (0/1) and kind (class index).  Positives
    count double; the type model only sees positives.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = pooled.withColumn("vector", array_to_vector("features")).withColumn(
        "weight", F.when(F.col("label") == 1, positive_weight).otherwise(1.0))
    risk = LogisticRegression(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=20, regParam=0.01)
    kind = LogisticRegression(featuresCol="vector", labelCol="kind", maxIter=20, regParam=0.01, family="multinomial",
                              predictionCol="kind_prediction", probabilityCol="kind_probability", rawPredictionCol="kind_raw")
    data = data.cache()
    models = risk.fit(data), kind.fit(data.filter(F.col("label") == 1))
    data.unpersist()
    return models


def apply_graph_classifier(pooled: DataFrame, models) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    risk, kind = models
    scored = kind.transform(risk.transform(pooled.withColumn("vector", array_to_vector("features"))))
    return scored.withColumn("confidence", vector_to_array("probability")[1]).drop(
        "vector", "rawPrediction", "probability", "kind_raw", "kind_probability", "features")
