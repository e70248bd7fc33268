"""Unusual code: fingerprints, anomaly scores and candidates."""
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lookup import let
from ..functions.scoring import clamp
from ..session import cut_lineage
from . import graph as G
from . import segments as S
from .clusters import density_clusters
from .similarity import Pick, match

SAMPLE = 256
TREES = 100
EULER = 0.5772156649


def fingerprints(segments: DataFrame, *keep: str) -> DataFrame:
    """Whole embedding, graph shape, text statistics and security flags as one vector.

    ``segments`` has (id, content, embedding); everything is computed inside its row.
    """
    def shape(nodes):
        steps = F.greatest(F.size(nodes) - 1, F.lit(0))
        return F.struct(F.size(nodes).alias("n"), (steps + F.size(G._definition_pairs(nodes))).alias("e"))

    graphs = G.file_graphs(segments, "id", "content", "embedding", *keep)
    shaped = graphs.select("id", "content", "embedding", *keep, let(F.col("nodes"), shape).alias("_g")).withColumns(
        {"_n": F.col("_g.n"), "_edges": F.col("_g.e")})
    stats = S.segment_statistics(F.col("content"))
    numbers = [
        F.col("_n"), F.col("_edges"), F.col("_n") / F.greatest(T.line_count(F.col("content")), F.lit(1)),
        F.coalesce(F.try_divide(F.col("_edges"), F.col("_n")), F.lit(0.0)), *stats.values(),
    ]
    tail = F.array(*[c.cast("double") for c in numbers])
    head = F.col("embedding").cast("array<double>")
    return shaped.select("id", *keep, "content", F.concat(head, tail).alias("fingerprint"))


def distance_scores(queries: DataFrame, known: DataFrame) -> DataFrame:
    """Minus a hundredth of the distance to the nearest known vector; null when none is known."""
    refs = known.withColumn("ref_group", F.lit(0).cast("long"))
    nearest = match(queries, refs, Pick("top", metric="distance", k=1))
    scored = queries.select("id").join(nearest.select(F.col("query_id").alias("id"), "score"), "id", "left")
    return scored.select("id", (-F.col("score") / 100).alias("anomaly_score"), F.col("score").isNull().alias("no_baseline"))


def candidate_confidence(score: Column, risk: Column, similar: Column) -> Column:
    confidence = F.lit(0.5)
    confidence = confidence + F.when(score < -1.0, 0.3).when(score < -0.5, 0.2).otherwise(0.0)
    confidence = confidence + F.when(F.contains(risk, F.lit("CRITICAL")), 0.2).when(F.contains(risk, F.lit("HIGH")), 0.1).otherwise(0.0)
    confidence = confidence - F.when(similar > 3, 0.1).when(similar > 0, 0.05).otherwise(0.0)
    return clamp(confidence, 0.0, 1.0)


def similar_known(queries: DataFrame, known: DataFrame, eps: float = 0.3, most: int | None = None) -> DataFrame:
    """How many known vectors share the query's density cluster, all of them or counted up to ``most``.

    A query near no known vector is noise, and shares that label with the lone known ones.
    """
    labels = density_clusters(known.select("id", "embedding"), eps)
    sizes = labels.filter("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("members"))
    lone = labels.agg(F.count_if(F.col("cluster") < 0).alias("lone"))
    # copies of a vector share its cluster
    refs = known.groupBy("embedding").agg(F.min("id").alias("id")).withColumn("ref_group", F.lit(0).cast("long"))
    near = match(queries, refs, Pick("range", metric="distance", high=np.nextafter(eps, 1))).join(
        labels.withColumnRenamed("id", "ref_id"), "ref_id")
    # each touched cluster once, each touched lone vector for itself
    touched = near.select("query_id", "cluster", F.when(F.col("cluster") < 0, F.col("ref_id")).alias("single")).distinct()
    counted = touched.join(sizes, "cluster", "left").groupBy(F.col("query_id").alias("id")).agg(
        F.sum(F.coalesce("members", F.lit(1))).alias("members"))
    total = queries.select("id").join(counted, "id", "left").select("*", lone.scalar().alias("lone"))
    similar = F.coalesce("members", "lone")
    return total.select("id", (similar if most is None else F.least(similar, F.lit(most))).alias("similar_count"))


def anomaly_candidates(queries: DataFrame, known: DataFrame, most: int | None = None, score=None) -> DataFrame:
    """Unusual segments that look risky enough; ``most`` bounds the reported ``similar_count``.

    Both frames have (id, content, fingerprint).  ``score(queries, known)`` gives (id, anomaly_score); by default the distance
    to the nearest known vector, which only vectors far from all known ones fail.  ``forest_scores`` also finds vectors beside
    known ones, in regions where even the known ones are rare.
    """
    code = F.col("content")
    # fingerprints read the whole text once; what is kept of it afterwards is small
    described = cut_lineage(queries.select(
        "id", F.col("fingerprint").alias("embedding"), S.risk_tier(code).alias("risk_assessment"),
        S.predicted_cwe(code).alias("predicted_cwe"), F.concat(F.lit("ZERO-DAY-"), F.md5(code)).alias("candidate_id")))
    k = cut_lineage(known.select("id", F.col("fingerprint").alias("embedding")))
    scores = (score or distance_scores)(described, k).select("id", "anomaly_score")
    odd = cut_lineage(scores.filter(F.col("anomaly_score") < -0.5))  # no row is scored twice, as it is used twice below
    similar = similar_known(described.join(odd.select("id"), "id", "left_semi"), k, most=most)
    rated = described.drop("embedding").join(odd, "id").join(similar, "id")
    return rated.withColumn(
        "confidence", candidate_confidence(F.col("anomaly_score"), F.col("risk_assessment"), F.col("similar_count"))
    ).filter(F.col("confidence") > 0.6)


def anomaly_summary(candidates: DataFrame, evolutions: DataFrame, as_of: Column) -> DataFrame:
    """(measure, key, value) rows: totals, recent, risk levels, CWEs and evolutions."""
    risk = F.split_part("risk_assessment", F.lit(":"), F.lit(1))
    grouped = candidates.groupBy(risk.alias("risk"), "predicted_cwe").agg(
        F.count("*").alias("n"), F.count_if(F.col("confidence") > 0.8).alias("high"),
        F.count_if(F.col("first_seen") > as_of - F.expr("INTERVAL 24 HOURS")).alias("recent"))

    def measured(name, key, value):
        return F.struct(F.lit(name).alias("measure"), key.alias("key"), F.col(value).alias("value"))

    rows = grouped.select(F.inline(F.array(
        measured("total_candidates", F.lit(""), "n"),
        measured("high_confidence", F.lit(""), "high"),
        measured("recent_24h", F.lit(""), "recent"),
        measured("risk_distribution", F.col("risk"), "n"),
        measured("predicted_cwes", F.col("predicted_cwe"), "n"),
    ))).filter("key IS NOT NULL")
    evolved = evolutions.agg(F.count("*").alias("value")).select(F.lit("evolution_patterns").alias("measure"), F.lit("").alias("key"), "value")
    return rows.groupBy("measure", "key").agg(F.sum("value").alias("value")).unionByName(evolved)


# -------------------------------------------------------------------- isolation forest

def average_path(n) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _grow(points, rng, depth, limit, rows):
    """Append the nodes of one tree as (feature, cut, left, right, extra depth)."""
    at = len(rows)
    rows.append(None)
    spread = np.flatnonzero(points.max(0) > points.min(0)) if len(points) > 1 else []
    if depth >= limit or len(spread) == 0:
        rows[at] = (-1, 0.0, -1, -1, depth + average_path(len(points)))
        return at
    feature = int(rng.choice(spread))
    cut = rng.uniform(points[:, feature].min(), points[:, feature].max())
    below = points[:, feature] < cut
    left = _grow(points[below], rng, depth + 1, limit, rows)
    right = _grow(points[~below], rng, depth + 1, limit, rows)
    rows[at] = (feature, float(cut), left, right, 0.0)
    return at


def fit_isolation_forest(known: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """One row per tree node; each tree is grown in its own task from its own sample.

    A tree's sample is the ``sample`` rows with the smallest hash for that tree.  A row draws its trees
    from its id alone, by hashes small enough for about four samples a tree, and only then is its vector copied
    to them, so that the vectors that travel are as few however large the training set is.
    """
    n = known.count()
    spread = float(2**32)
    keep = spread if n <= 4 * sample else spread * 4 * sample / n
    drawn = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
            t.alias("tree"), F.pmod(F.xxhash64("id", t, F.lit(seed)), F.lit(2**32)).alias("h"))),
        lambda d: d["h"] < keep)
    offered = known.select("id", "embedding", F.inline(drawn))
    smallest = Window.partitionBy("tree").orderBy("h", "id")
    chosen = offered.withColumn("p", F.row_number().over(smallest)).filter(F.col("p") <= sample)

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "id"])
        tree = int(part["tree"].iloc[0])
        points = np.array([np.asarray(v, dtype=np.float64) for v in part["embedding"]])
        rows = []
        limit = int(np.ceil(np.log2(max(len(points), 2))))
        _grow(points, np.random.default_rng([seed, tree]), 0, limit, rows)
        out = pd.DataFrame(rows, columns=["feature", "cut", "left", "right", "path"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        out["sample"] = len(points)
        return out

    schema = "tree int, node int, feature int, cut double, left int, right int, path double, sample int"
    return chosen.groupBy("tree").applyInPandas(grow, schema)


def forest_scores(queries: DataFrame, known: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """(id, anomaly_score) of each query in a forest grown on the known vectors; null scores without any."""
    forest = cut_lineage(fit_isolation_forest(known, trees, sample, seed))
    if not forest.head(1):
        return queries.select("id", F.lit(None).cast("double").alias("anomaly_score"))
    return isolation_scores(queries, forest)


def isolation_scores(rows: DataFrame, forest: DataFrame) -> DataFrame:
    """Score in [-1, 0): the lower, the easier a vector is isolated.

    The forest has at most ``2 * sample`` nodes per tree whatever the data, so it is sent
    to every task.
    """
    nodes = forest.orderBy("tree", "node").toPandas()
    packed = [
        tuple(t[c].to_numpy() for c in ["feature", "cut", "left", "right", "path"]) for _, t in nodes.groupby("tree")]
    norm = average_path(int(nodes["sample"].iloc[0]))
    shared = rows.sparkSession.sparkContext.broadcast((packed, norm))

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        trees, scale = shared.value
        points = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
        total = np.zeros(len(points))
        for feature, cut, left, right, path in trees:
            at = np.zeros(len(points), dtype=np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                f = np.where(inner, feature[at], 0)
                goes_left = points[np.arange(len(points)), f] < cut[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            total += path[at]
        return pd.Series(-np.power(2.0, -(total / len(trees)) / scale))

    return rows.select("id", score("embedding").alias("anomaly_score"))
