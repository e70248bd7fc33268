"""How much one task gets."""
from pyspark.sql import functions as F

from siftline.operators import anomaly as An
from siftline.operators import dataset as D
from siftline.session import spread


def test_short_rows_are_spread_by_their_number(spark):
    rows = spark.range(0, 1000, 1, 1)
    assert spread(rows).rdd.getNumPartitions() == 8
    assert spread(rows, 50).rdd.getNumPartitions() == 20
    assert spread(rows, 50).agg(F.sum("id")).first()[0] == 499_500


def test_samples_are_numbered_in_blocks_of_their_ids(spark):
    n = 2 * D.SPLIT_BLOCK
    samples = spark.range(n).select(F.col("id").alias("file_id"), (F.col("id") % 2).cast("int").alias("label"), F.lit("text").alias("code"))
    split = D.balanced_split(samples)
    assert "_block1" in split._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["label"], r["split"]): (r["n"], r["low"], r["high"]) for r in split.groupBy("label", "split").agg(
        F.count("*").alias("n"), F.min("file_id").alias("low"), F.max("file_id").alias("high")).collect()}
    half, cut = n // 2, int(n // 2 * 0.8)
    assert got == {(k, part): (m, low, high) for k in (0, 1) for part, m, low, high in [
        ("train", cut, k, 2 * (cut - 1) + k), ("test", half - cut, 2 * cut + k, n - 2 + k)]}


def test_candidates_are_scored_once(spark):
    scored = spark.sparkContext.accumulator(0)

    def score(queries, known):
        def count(batches):
            for batch in batches:
                scored.add(len(batch))
                yield batch[["id"]].assign(anomaly_score=-2.0)
        return queries.select("id").mapInPandas(count, "id long, anomaly_score double")

    def vectors(ids):
        return spark.createDataFrame([(i, "exec(system)", [float(100 * i), 0.0]) for i in ids], "id long, content string, fingerprint array<double>")

    plain = An.distance_scores
    An.distance_scores = score  # the default scorer, whose result used to be left to be computed again
    try:
        found = An.anomaly_candidates(vectors(range(10, 20)), vectors(range(3)))
        assert found.count() == found.count() == 10
    finally:
        An.distance_scores = plain
    assert scored.value == 10
