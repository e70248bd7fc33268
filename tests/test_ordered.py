"""Blocked order-dependent operators against plain Python, with blocks far smaller than a key."""
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.operators import ordered

SETTINGS = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def keyed_rows(seed, n):
    rng = random.Random(seed)
    seqs = rng.sample(range(10 * n), n)
    # two thirds of the rows belong to one key
    return [("hot" if rng.random() < 0.66 else f"k{rng.randrange(3)}", s, rng.randrange(5)) for s in seqs]


@SETTINGS
@given(seed=st.integers(0, 10**6))
def test_running_sums_and_row_numbers(spark, seed):
    rows = keyed_rows(seed, 60)
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    got = {(r.k, r.seq): r.total for r in ordered.running_sums(df, ["k"], "seq", {"total": F.col("v")}, block=9).collect()}
    position = {(r.k, r.seq): r.row_no for r in ordered.row_numbers(df, ["k"], "seq", block=9).collect()}
    for key in {r[0] for r in rows}:
        total = 0
        for i, (_, seq, v) in enumerate(sorted(r for r in rows if r[0] == key), 1):
            total += v
            assert got[key, seq] == total
            assert position[key, seq] == i


@SETTINGS
@given(seed=st.integers(0, 10**6))
def test_previous_values(spark, seed):
    rows = keyed_rows(seed, 60)
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    got = {(r.k, r.seq): r.before for r in ordered.previous_values(df, ["k"], "seq", {"before": "v"}, block=9).collect()}
    for key in {r[0] for r in rows}:
        before = None
        for _, seq, v in sorted(r for r in rows if r[0] == key):
            assert got[key, seq] == before
            before = v


@SETTINGS
@given(seed=st.integers(0, 10**6))
def test_gap_to_next(spark, seed):
    rows = keyed_rows(seed, 60)
    df = spark.createDataFrame(rows, "k string, at long, v long")
    got = {(r.k, r.at): r.gap for r in ordered.gap_to_next(df, ["k"], "at", "gap", 5, bucket=5).collect()}
    for key in {r[0] for r in rows}:
        times = sorted(r[1] for r in rows if r[0] == key)
        for t, after in zip(times, [*times[1:], None]):
            gap = after - t if after is not None and after - t < 5 else None
            assert got[key, t] == gap


def test_null_keys_and_null_places_stay(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", None, 7), ("a", 4, 8)], "k string, seq long, v int")
    got = {(r.k, r.seq): (r.before, r.total) for r in ordered.running_sums(
        ordered.previous_values(df, ["k"], "seq", {"before": "v"}, block=2), ["k"], "seq", {"total": F.col("v")}, block=2).collect()}
    assert got == {(None, 1): (None, 5), (None, 2): (5, 11), ("a", None): (None, 7), ("a", 4): (7, 15)}
    near = ordered.gap_to_next(df.filter("k IS NULL"), ["k"], "seq", "gap", 5, bucket=8).collect()
    assert sorted((r.seq, r.gap) for r in near) == [(1, 1), (2, None)]


def test_hashed_places_null_keys_and_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", None, "b"]), rng.randrange(-(1 << 62), 1 << 62), rng.randrange(9)) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, seq long, v long").repartition(7)
    assert ordered._levels(df, "seq", 1 << 20) == 3
    want, held = {}, {}
    for k, seq, v in sorted(rows, key=lambda r: r[1]):
        total, number, last = held.get(k, (0, 0, None))
        held[k] = (total + v, number + 1, v)
        want[k, seq] = (total + v, number + 1, last)
    for block in (1 << 20, 50):
        summed = ordered.running_sums(df, ["k"], "seq", {"total": "v", "number": F.lit(1).cast("long")}, block)
        got = {(r.k, r.seq): (r.total, r.number, r.before) for r in ordered.previous_values(summed, ["k"], "seq", {"before": "v"}, block).collect()}
        assert got == want


def test_no_window_holds_more_than_a_block(spark):
    """Every window of a cut plan is partitioned by the block, also without keys."""
    df = spark.range(0, 1000).selectExpr("xxhash64(id) AS seq", "id AS v")
    plan = ordered.row_numbers(df, [], "seq", block=1 << 20)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 4 and sum("_block" in line.split("windowspecdefinition")[1].split("ASC")[0] for line in windows) >= 3
    assert "Join" not in ordered.row_numbers(spark.range(1000), [], "id")._jdf.queryExecution().optimizedPlan().toString()


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, seq long, v long")
    assert ordered.row_numbers(df, ["k"], "seq").count() == 0
    assert ordered.previous_values(df, ["k"], "seq", {"before": "v"}).count() == 0
