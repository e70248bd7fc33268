from fractions import Fraction
from math import floor

import numpy as np
import pytest

from siftline.llm import whitening as W

SCHEMA = "vec_id long, embedding array<{}>, label int, n string, component string"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "n", "c") for i, v in rows], SCHEMA.format(kind))


def plain(rows, kind=np.float32):
    """Exact integers, sums, covariance and deviations by the definition."""
    usable = [(i, [float(kind(x)) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    x = [[floor(1024 * Fraction(c)) + 100000 for c in v] for _, v in usable]
    n, width = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(width)]
    covariance = [[float(Fraction(sum((n * r[a] - sums[a]) * (n * r[b] - sums[b]) for r in x), n ** 3)) for b in range(width)] for a in range(width)]
    deviation = [sum((n * r[d] - sums[d]) ** 2 for d in range(width)) for r in x]
    return [i for i, _ in usable], np.array(x, object), sums, np.array(covariance), deviation


def check(df, rows, components=8, kind=np.float32):
    ids, x, sums, covariance, deviation = plain(rows, kind)
    n, width = len(ids), len(sums)
    got = df.collect()
    assert len(got) == n * min(components, width)
    by_id = dict(zip(ids, deviation))
    values = np.linalg.eigvalsh(covariance)[::-1]
    whitened = np.full((n, min(components, width)), np.nan)
    place = {i: k for k, i in enumerate(ids)}
    for r in got:
        assert r["n"] == n and int(r["deviation_exact"]) == by_id[r["vec_id"]] and r["deviation"] in (None, by_id[r["vec_id"]])
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(covariance), rel=1e-6, abs=1e-12)
        whitened[place[r["vec_id"]], r["component"] - 1] = np.nan if r["whitened"] is None else r["whitened"]
    return whitened, got, covariance, np.array([[float(Fraction(int(v) * n - s, n)) for v, s in zip(r, sums)] for r in x])


def test_against_exact_fractions(spark):
    rng = np.random.default_rng(2)
    mix = rng.standard_normal((12, 12))
    rows = [(k, (rng.standard_normal(12) @ mix * 0.1).tolist()) for k in range(150)]
    whitened, got, covariance, centred = check(W.whiten(table(spark, rows)), rows)
    spread = whitened.T @ whitened / len(whitened)
    measured = np.abs(spread - np.eye(8)).max()
    assert measured < 1e-10 and got[0]["identity_error"] < 1e-10
    _, vectors = np.linalg.eigh(covariance)
    for k in range(8):
        want = centred @ vectors[:, -1 - k] / np.sqrt(vectors[:, -1 - k] @ covariance @ vectors[:, -1 - k])
        sign = np.sign(want @ whitened[:, k])
        assert np.allclose(sign * want, whitened[:, k], rtol=1e-9, atol=1e-9)


def test_sums_are_exact_in_any_slices(monkeypatch):
    rng = np.random.default_rng(4)
    for x in (rng.integers(-5000, 200000, (333, 7)), rng.integers(-(1 << 62), 1 << 62, (130, 3)), np.full((5, 4), 7), np.array([[3, -9]])):
        rows, sums, products = W.slice_sums(x.astype(np.int64))
        big = x.astype(object)
        assert rows == len(x) and sums.tolist() == big.sum(axis=0).tolist()
        assert products.tolist() == (big.T @ big).tolist()
        for v in (*sums, *products.ravel()):
            d = W.digits(int(v))
            assert sum(k << (32 * j) for j, k in enumerate(d)) == v and all(-(1 << 63) <= k < 1 << 63 for k in d)


def test_rows_left_out_and_kept(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.standard_normal(3).tolist()) for k in range(40)] + [(41, None), (42, [1.0, None, 2.0]), (43, [float("nan"), 0, 0]), (44, [float("-inf"), 0, 0])]
    rows = [(i, None if v is None else list(v)) for i, v in rows] + [(45, [0.0, 0.0, 0.0]), (46, [2.0, -200.0, 1e-9])]
    odd = [(47, []), (48, [1.0]), (49, [1.0] * 4)]
    check(W.whiten(table(spark, rows + odd)), rows)


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (8, [3.0, -1.0])]
    got = W.whiten(table(spark, rows)).collect()
    assert len(got) == 10 and {r["n"] for r in got} == {5} and sorted(r["vec_id"] or 0 for r in got) == [0] * 4 + [7] * 4 + [8] * 2


def test_no_spread(spark):
    for rows in ([(1, [0.5, 2.0])], [(k, [0.5, 2.0]) for k in range(9)]):
        got = W.whiten(table(spark, rows)).collect()
        assert len(got) == 2 * len(rows) and all((r["whitened"], r["explained"], r["identity_error"], r["deviation"]) == (None, None, None, 0) for r in got)
    got = W.whiten(table(spark, [(k, [k, 2.0 * k, 3.0]) for k in range(9)])).collect()
    assert {r["component"] for r in got if r["whitened"] is not None} == {1}
    assert all(r["identity_error"] < 1e-9 for r in got)


def test_empty_tables(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [float("nan")])]):
        df = W.whiten(table(spark, rows))
        assert df.count() == 0 and df.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_huge_entries(spark):
    rng = np.random.default_rng(9)
    rows = [(k, list(rng.standard_normal(3) * np.array([1e12, 1.0, 1e3]))) for k in range(60)]
    whitened, got, *_ = check(W.whiten(table(spark, rows, "double")), rows, kind=np.float64)
    assert all(r["deviation"] is None for r in got)  # beyond a long, in deviation_exact
    W.whiten(table(spark, [(k, [1e300 * (-1) ** k, k]) for k in range(5)], "double")).collect()
