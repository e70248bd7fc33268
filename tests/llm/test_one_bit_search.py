import numpy as np
import pytest

from siftline.llm import one_bit_search as S

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, id int, length string"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "v", 2, "l") for i, v in rows], schema)


def plain(rows, every=100, k=10):
    """Distances of every usable pair, in double precision of the stored single-precision entries."""
    width = 0
    usable = [(i, [float(np.float32(x)) for x in v]) for i, v in rows
              if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    if usable:
        lengths = [len(v) for _, v in usable]
        width = max(set(lengths), key=lambda n: (lengths.count(n), n))
    usable = [(i, np.array(v)) for i, v in usable if len(v) == width]
    out, asked = [], {(i, v.tobytes()): v for i, v in usable if i is not None and i % every == 0}
    for (q, _), v in asked.items():
        near = sorted((float(np.sqrt(((v - w) ** 2).sum())), i is None, i) for i, w in usable if i != q)
        out += [(q, n + 1, i, d) for n, (d, _, i) in enumerate(near[:k])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=repr)


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=1e-300)


def clustered(n, width, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, width))
    return [(k, (centres[k % 5] + 0.7 * rng.standard_normal(width)).astype(np.float32)) for k in range(n)]


@pytest.mark.parametrize("width", [64, 100, 16])
def test_recall_against_every_pair(spark, width):
    rows = clustered(3000, width)
    got = {(r["query_id"], r["vec_id"]) for r in S.nearest(table(spark, rows), every=50).collect()}
    want = {(q, i) for q, _, i, _ in plain(rows, every=50)}
    assert len(got) == len(want) and len(got & want) >= 0.99 * len(want)


def test_blocks_of_queries_give_the_same(spark):
    df = table(spark, clustered(900, 64))
    assert rows_of(S.nearest(df, every=10)) == rows_of(S.nearest(df, every=10, query_block=17))


def test_ties_copies_and_rows_that_take_no_part(spark):
    hot = [0.5] * 8
    rows = [(k, hot) for k in range(0, 400)] + [(500, [9.0] * 8), (500, [9.0] * 8), (500, [8.0] * 8), (501, [9.0] * 8), (501, [9.0] * 8)]
    rows += [(None, hot), (None, [9.0] * 8), (600, None), (700, []), (800, [0.0] * 8), (900, [1.0, None] * 4), (1000, [float("nan")] * 8),
             (1100, [float("inf")] * 8), (1200, [1.0] * 5), (-100, [-3.0] * 8)]
    same(rows_of(S.nearest(table(spark, rows))), plain(rows))


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [4.0, 2.0])]
    same(rows_of(S.nearest(table(spark, rows))), plain(rows))
    for few in ([], [(0, [1.0])], [(1, [1.0]), (2, [2.0])], [(0, None)], [(0, [0.0])]):
        same(rows_of(S.nearest(table(spark, few))), plain(few))


def test_very_long_and_very_short_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.standard_normal(32) * 10.0 ** (k % 7 * 10 - 30)) for k in range(700)]
    schema = SCHEMA.replace("float", "double")
    df = spark.createDataFrame([(i, v.tolist(), 1, "v", 2, "l") for i, v in rows], schema)
    got = rows_of(S.nearest(df, every=10))
    usable = {i: v for i, v in rows}
    for q, rank, i, d in got:
        assert np.isclose(d, np.linalg.norm(usable[q] - usable[i]), rtol=1e-12)
    want = {(q, i) for q in range(0, 700, 10) for i in sorted((i for i in usable if i != q), key=lambda i: (np.linalg.norm(usable[q] - usable[i]), i))[:10]}
    assert len(want & {(q, i) for q, _, i, _ in got}) >= 0.98 * len(want)


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(8)
    vectors, asked = rng.standard_normal((4000, 64)), rng.standard_normal((50, 64))
    turn, centre = S.rotation(64), np.zeros(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    codes = S.Codes.of(vectors, centre, turn)
    queries = S.Queries(np.arange(50), asked, np.full(50, np.inf), centre, turn)
    bound = queries.least_distances(slice(0, 50), codes)
    exact = ((asked[:, None] - vectors[None]) ** 2).sum(axis=2)
    assert (bound <= exact).mean() > 0.998
    # even without any structure in the vectors, half of them need no comparison
    assert (bound > np.sort(exact, axis=1)[:, 9:10]).mean() > 0.5
