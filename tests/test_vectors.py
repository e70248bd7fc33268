"""Vector matching, density clusters and anomaly scores against brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.operators import anomaly, clusters, similarity
from siftline.operators.similarity import Pick, match
from siftline.plans.catalog import QUERIES


def vectors(spark, seed, n, width=6, groups=3, spread=1.0):
    rng = np.random.default_rng(seed)
    rows = [(i, i % groups, [float(x) for x in np.float32(rng.normal(size=width) * spread)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, ref_group long, embedding array<float>"), rows


def result(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("pick", [
    Pick("range", low=0.5, high=0.95), Pick("top", k=3), Pick("top", metric="distance", k=2), Pick("groups")])
def test_tiles_give_the_same_rows_as_one_broadcast(spark, pick):
    queries, _ = vectors(spark, 1, 40)
    refs, _ = vectors(spark, 2, 50)
    whole = result(match(queries, refs, pick))
    assert whole == result(match(queries, refs, pick, limit_bytes=0, tile_rows=8))
    assert whole


def test_top_matches_brute_force(spark):
    queries, q = vectors(spark, 3, 15)
    refs, r = vectors(spark, 4, 30)
    got = {}
    for row in match(queries, refs, Pick("top", k=2)).collect():
        got.setdefault(row.query_id, set()).add(row.ref_id)
    for qid, _, a in q:
        sims = sorted(((-np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b), rid) for rid, _, b in r))[:2]
        assert got[qid] == {rid for _, rid in sims}


def brute_clusters(rows, eps):
    n = len(rows)
    label = list(range(n))
    near = [[np.linalg.norm(np.array(a[2]) - np.array(b[2])) <= eps for b in rows] for a in rows]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min(label[j] for j in range(n) if near[i][j])
            if low < label[i]:
                label[i], changed = low, True
    sizes = {l: label.count(l) for l in label}
    numbers = {l: k for k, l in enumerate(sorted(l for l in sizes if sizes[l] > 1))}
    return {rows[i][0]: numbers.get(label[i], -1) for i in range(n)}


@pytest.mark.parametrize("seed,block", [(5, 2048), (6, 9)])
def test_density_clusters(spark, seed, block):
    _, rows = vectors(spark, seed, 90, width=2, spread=2.0)
    rows += [(100 + i, 0, rows[0][2]) for i in range(45)]  # a third are copies of one vector
    df = spark.createDataFrame(rows, "id long, ref_group long, embedding array<float>").drop("ref_group")
    got = {r.id: r.cluster for r in clusters.density_clusters(df, 0.3, block).collect()}
    assert got == brute_clusters(rows, 0.3)


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.root for r in clusters.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_isolation_forest_finds_the_outlier_and_repeats(spark):
    known, rows = vectors(spark, 7, 400, width=3, spread=0.1)
    forest = anomaly.fit_isolation_forest(known, trees=30, sample=64)
    assert forest.select("tree").distinct().count() == 30
    odd = spark.createDataFrame([(1, rows[0][2]), (2, [9.0, 9.0, 9.0])], "id long, embedding array<float>")
    scores = {r.id: r.anomaly_score for r in anomaly.isolation_scores(odd, forest).collect()}
    again = {r.id: r.anomaly_score for r in anomaly.isolation_scores(odd, anomaly.fit_isolation_forest(known, trees=30, sample=64)).collect()}
    assert scores == again
    assert -1 <= scores[2] < scores[1] < 0


def test_no_known_vectors_means_no_baseline(spark):
    queries, _ = vectors(spark, 8, 3)
    row = anomaly.distance_scores(queries, queries.filter("id < 0")).first()
    assert row.anomaly_score is None and row.no_baseline


def test_slices_of_references_give_the_same_rows(monkeypatch):
    rng = np.random.default_rng(4)
    queries, refs = rng.integers(0, 3, (20, 4)).astype(float), rng.integers(0, 3, (57, 4)).astype(float)
    ids, groups = np.arange(57), np.arange(57) % 3
    for pick in (similarity.Pick("top", k=5), similarity.Pick("top", metric="distance", k=3), similarity.Pick("groups"), similarity.Pick("range", low=0.3, high=0.9)):
        seen = []
        for scores in (10**9, 130):
            monkeypatch.setattr(similarity, "SCORES", scores)
            got = similarity._pick(np.arange(20), queries, ids, groups, refs, pick)
            seen.append(sorted(map(tuple, got.round(9).to_numpy().tolist())))
        assert seen[0] == seen[1] and seen[0]


def test_similar_known_counts_every_lone_vector(spark):
    from siftline.operators.anomaly import similar_known

    known = spark.createDataFrame([(k, [10.0 * k, 0.0]) for k in range(8)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(100, [5.0, 500.0])], "id long, embedding array<double>")
    assert [r["similar_count"] for r in similar_known(queries, known).collect()] == [8]
    assert [r["similar_count"] for r in similar_known(queries, known, most=5).collect()] == [5]


def test_forest_invariants(spark):
    known, rows = vectors(spark, 11, 1500, width=4)
    forest = anomaly.fit_isolation_forest(known, trees=12, sample=32).collect()
    by_tree = {}
    for r in forest:
        by_tree.setdefault(r.tree, {})[r.node] = r
    assert sorted(by_tree) == list(range(12))
    for nodes in by_tree.values():
        assert sorted(nodes) == list(range(len(nodes)))
        seen, queue = [], [(0, 0)]
        while queue:
            at, depth = queue.pop()
            seen.append(at)
            r = nodes[at]
            assert depth <= 5 and r.sample == 32
            if r.feature < 0:
                assert depth <= r.path <= depth + anomaly.average_path(32)
            else:
                queue += [(r.left, depth + 1), (r.right, depth + 1)]
        assert sorted(seen) == sorted(nodes)  # each node has one parent
        leaves = [r for r in nodes.values() if r.feature < 0]
        assert len(leaves) <= 32 and len(nodes) == 2 * len(leaves) - 1
    scores = anomaly.isolation_scores(known, anomaly.fit_isolation_forest(known, trees=12, sample=32)).collect()
    assert all(-1 <= r.anomaly_score < 0 for r in scores)


def test_forest_finds_candidates_beside_known_vectors(spark):
    """A rare known vector: its copy is no candidate by distance, and one by the forest, with few similar ones."""
    rng = np.random.default_rng(3)
    rows = [(k, "plain = text", [float(x) for x in rng.normal(size=3) * 0.05]) for k in range(300)]
    rows += [(300 + k, "plain = text", [40.0 + 0.1 * k, 40.0, 40.0]) for k in range(2)]
    risky = "query = input() + eval(request) # sql exec system pickle"
    asked = [(1000, risky, [40.05, 40.0, 40.0]), (1001, risky, [0.0, 0.0, 0.0])]
    schema = "id long, content string, fingerprint array<double>"
    known, queries = spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema)
    assert anomaly.anomaly_candidates(queries, known).count() == 0
    found = {r.id: r for r in anomaly.anomaly_candidates(queries, known, score=anomaly.forest_scores).collect()}
    assert set(found) == {1000} and found[1000].similar_count == 2  # the two known ones beside it, not the lone ones
    assert anomaly.forest_scores(queries.withColumn("embedding", F.col("fingerprint")), known.limit(0).withColumn("embedding", F.col("fingerprint"))).filter("anomaly_score IS NOT NULL").count() == 0


def test_close_pairs_of_single_and_double_precision_equal_the_distances():
    rng = np.random.default_rng(9)
    for scale, kind in ((0.5, np.float32), (3000.0, np.float64)):  # the second is too coarse for single precision
        a = rng.normal(size=(60, 8)).astype(kind) * kind(scale)
        b = np.concatenate([a[:40] + rng.normal(size=(40, 8)) * 0.1, a[40:50], rng.normal(size=(30, 8)) * scale])
        want = {(i, j) for i in range(60) for j in range(80) if np.sqrt(((a[i].astype(float) - b[j]) ** 2).sum()) <= 0.3}
        i, j = similarity.close_pairs(a, b, 0.3)
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want) > 20


def test_pairs_of_blocks_meet_once(spark, monkeypatch):
    """Lone vectors all equally far from each other: each pair of them is compared once, in however many blocks."""
    seen = spark.sparkContext.accumulator(0)
    plain = clusters._block_links

    def counted(left, right, eps, same):
        seen.add(len(left[0]) * (len(left[0]) + 1) // 2 if same else len(left[0]) * len(right[0]))
        return plain(left, right, eps, same)

    monkeypatch.setattr(clusters, "_block_links", counted)
    df = spark.createDataFrame([(k, [1.0 if i == k else 0.0 for i in range(40)]) for k in range(40)], "id long, embedding array<float>")
    assert {r.cluster for r in clusters.density_clusters(df, 0.3, 4).collect()} == {-1}
    assert seen.value <= 40 * 41 // 2


def test_vectors_without_a_distance_are_lone(spark):
    rows = [(0, None), (1, [float("nan"), 0.0]), (2, [None, 1.0]), (3, [0.0, 0.0]), (4, [0.1, 0.0]), (5, [float("inf"), 0.0]), (6, [0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    assert {r.id: r.cluster for r in clusters.density_clusters(df).collect()} == {0: -1, 1: -1, 2: -1, 3: 0, 4: 0, 5: -1, 6: -1}


def test_queries_are_dealt_by_the_references_they_meet(spark):
    """A few queries in one partition are as much work as there are references."""
    refs = spark.range(20_000).select("id", F.lit(0).cast("long").alias("ref_group"), F.array(F.col("id").cast("double"), F.lit(0.0)).alias("embedding"))
    queries = spark.range(40).select("id", F.array(F.col("id") + 0.25, F.lit(0.0)).alias("embedding")).coalesce(1)
    near = match(queries, refs, Pick("range", metric="distance", high=0.5))
    assert near.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    assert result(near) == [(k, k, 0, 0.25) for k in range(40)]


def test_distance_range_skips_vectors_that_are_not_finite():
    a = np.array([[0.0, 0.0], [np.nan, 0.0], [5.0, 0.0]])
    b = np.array([[np.inf, 0.0], [0.1, 0.0], [5.0, 0.2]])
    i, j = similarity.close_pairs(a, b, 0.3)
    assert list(zip(i.tolist(), j.tolist())) == [(0, 1), (2, 2)]
    found = similarity._pick(np.arange(3), a, np.arange(3), np.zeros(3, int), b, Pick("range", metric="distance", low=0.15, high=0.3))
    assert found[["query_id", "ref_id"]].to_numpy().tolist() == [[2, 2]]


@pytest.mark.parametrize("spread", [1.0, 200.0])
@pytest.mark.parametrize("pick", [Pick("top", metric="distance"), Pick("range", metric="distance", high=1.5)])
def test_blocks_give_the_same_distances_as_one_broadcast(spark, monkeypatch, pick, spread):
    """Copies, repeated ids and vectors without finite squares; one dimension may differ more than the others."""
    rng = np.random.default_rng(9)

    def rows(n, first):
        v = rng.normal(size=(n, 5))
        v[:, 2] *= spread
        got = [(first + i, i % 3, [float(x) for x in r]) for i, r in enumerate(v)]
        return got + [(first + n + i, 1, got[i][2]) for i in range(40)] + got[:20] + [(first + 2 * n, 0, [float("nan")] * 5)]

    schema = "id long, ref_group long, embedding array<double>"
    known, asked = rows(400, 0), rows(300, 5000)
    asked += [(9000 + i, 0, known[i][2]) for i in range(30)]
    queries, refs = spark.createDataFrame(asked, schema), spark.createDataFrame(known, schema)
    whole = match(queries, refs, pick).toPandas()
    met, meet = [], similarity._meet
    monkeypatch.setattr(similarity, "_meet", lambda rows, *args: met.append(rows.count()) or meet(rows, *args))
    parts = match(queries, refs, pick, limit_bytes=0, tile_rows=8).toPandas()

    def plain(found):  # a matrix product rounds the distance of copies up from 0
        return sorted((r.query_id, r.ref_id, r.ref_group, round(max(r.score, 1e-4), 6)) for r in found.itertuples())

    assert plain(whole) == plain(parts) and len(whole)
    if spread > 1:
        assert sum(met) < 3 * len(asked)  # of 13 blocks or more


def test_references_beyond_a_bound_do_not_pass_the_driver(spark, monkeypatch):
    """3000 vectors of 700 numbers; they used to be collected and sent to all tasks up to 64 MB."""
    def refuse(*args):
        raise AssertionError("references were collected")

    monkeypatch.setattr(similarity, "_match_broadcast", refuse)
    rest = F.array_repeat(F.lit(0.0), 699)
    known = spark.range(3000).select("id", F.concat(F.array((F.col("id") * 3).cast("double")), rest).alias("embedding"))
    queries = spark.range(500).select("id", F.concat(F.array((F.col("id") * 7 + 1).cast("double")), rest).alias("embedding"))
    got = {r.id: r.anomaly_score for r in anomaly.distance_scores(queries, known).collect()}
    assert got == {i: -min((7 * i + 1) % 3, 3 - (7 * i + 1) % 3) / 100 for i in range(500)}
    counts = {r.id: r.similar_count for r in anomaly.similar_known(queries, known, eps=0.3).collect()}
    assert counts == {i: 1 if (7 * i + 1) % 3 == 0 else 3000 for i in range(500)}


def test_copies_of_a_known_vector_meet_queries_once(spark, monkeypatch):
    """As many pairs as copies were made of each query beside a vector that is known often."""
    known = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(40)] + [(40, [0.2, 0.0]), (41, [9.0, 9.0])], "id long, embedding array<double>")
    queries = spark.createDataFrame([(100, [0.0, 0.1]), (101, [9.0, 9.1]), (102, [5.0, 5.0])], "id long, embedding array<double>")
    met, plain = [], anomaly.match
    monkeypatch.setattr(anomaly, "match", lambda q, refs, pick: met.append(refs.count()) or plain(q, refs, pick))
    assert {r.id: r.similar_count for r in anomaly.similar_known(queries, known).collect()} == {100: 41, 101: 1, 102: 1}
    assert met == [3]


@pytest.mark.parametrize("name", ["candidates_file", "forest_candidates"])
def test_candidates_are_the_same_by_blocks(spark, monkeypatch, tmp_path, name):
    """Every fourth text has no embedding; known vectors neither pass the driver nor meet all queries."""
    texts = ["exec(system) password\n" * (k % 7 + 1) + "x" * (k * k % 997) for k in range(120)]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, [float(k % 5), 1.0]) for k in range(120) if k % 4], "vec_id long, embedding array<float>").write.parquet(
        f"{tmp_path}/embeddings.parquet")

    def found():
        return sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(
            "id", "candidate_id", "anomaly_score", "similar_count", "risk_assessment", "predicted_cwe", "confidence").collect())

    def refuse(*args):
        raise AssertionError("not by blocks")

    whole = found()
    assert whole
    monkeypatch.setattr(similarity, "DISTANCE_BYTES", 0)
    for way in ("_match_broadcast", "_match_tiles"):
        monkeypatch.setattr(similarity, way, refuse)
    assert found() == whole
