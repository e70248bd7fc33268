"""Density clusters for ``min_samples = 2``: connected components of the closeness graph.

Exact copies are folded first.  The rest is cut into blocks along the distance to a pivot vector and
sorted by that to a second one within a block.  Every pair of blocks whose distances overlap meets
once, in a group of its own, and there only rows whose distances overlap.  A block travels as one row,
and a group returns one link per vector, not all close pairs.
"""
import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import distance
from ..session import cut_lineage
from . import ordered
from .similarity import SCORES, _matrix, close_pairs

PIVOTS = 2
BLOCK_ROWS = 2048
#: Large inputs take blocks of this many times ``BLOCK_ROWS``, as each row travels once per block it meets.
LARGE_BLOCKS = 8
#: Pivot distances of close vectors may differ by rounding as well.
ROUNDING = 1e-9

_BLOCKS = "block long, low double, high double, ids binary, places binary, vectors binary"


def close_links(points: DataFrame, eps: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b) links whose components are those of all pairs at most ``eps`` apart."""
    copies = points.groupBy("embedding").agg(F.min("id").alias("id"))
    folded = points.join(copies.withColumnRenamed("id", "b"), "embedding").filter("id <> b").select(F.col("id").alias("a"), "b")
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    usable = cut_lineage(copies.filter(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False))))
    pivots = [r["embedding"] for r in usable.orderBy("id").limit(PIVOTS).collect()]
    if not pivots:
        return folded.distinct()
    pivots = [p for p in pivots if len(p) == len(pivots[0])]
    places = [distance("embedding", F.array(*[F.lit(float(x)) for x in pivot])) for pivot in (pivots[0], pivots[-1])]
    # vectors of another width are near none of the first one's
    placed = usable.select("id", "embedding", places[0].alias("p0"), places[1].alias("p1")).filter("p0 IS NOT NULL")
    n = usable.count()
    rows = min(LARGE_BLOCKS * block_rows, max(block_rows, n // 10))
    blocks = cut_lineage(_blocks(placed, -(-n // rows), rows))
    bounds = blocks.select("block", "low", "high")
    reach = eps + ROUNDING * (eps + F.col("high"))
    pairs = bounds.select(F.col("block").alias("i"), F.col("low").alias("low_i"), (F.col("high") + reach).alias("reach_i")).join(
        F.broadcast(bounds.select(F.col("block").alias("j"), F.col("low").alias("low_j"), (F.col("high") + reach).alias("reach_j"))),
        F.expr("i <= j AND low_j <= reach_i AND low_i <= reach_j")).select("i", "j")
    # columns of the two sides are renamed, as both come from the same blocks
    sides = [blocks.join(pairs, F.col("block") == F.col(k)).select(
        *[F.col(c).alias(f"{c}_{k}") for c in ("i", "j", "ids", "places", "vectors")]).groupBy(f"i_{k}", f"j_{k}") for k in "ij"]

    single = _is_single(placed)

    def link(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _block_links(_unpacked(left, single), _unpacked(right, single), eps, key[0] == key[1])

    return sides[0].cogroup(sides[1]).applyInPandas(link, "a long, b long").unionByName(folded).distinct()


def _blocks(placed: DataFrame, n: int, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` neighbours by the first pivot, each packed into one row and sorted by the second."""
    single = _is_single(placed)

    def pack(batches):
        held, size, k = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            while len(batch):
                part, batch = batch.iloc[:rows - size], batch.iloc[rows - size:]
                held.append(part)
                size += len(part)
                if size == rows:
                    yield one(k, pd.concat(held))
                    held, size, k = [], 0, k + 1
        if held:
            yield one(k, pd.concat(held))

    def one(k, part):
        part = part.sort_values(["p1", "id"])
        vectors = _matrix(part["embedding"])
        return pd.DataFrame({
            "block": [k], "low": part["p0"].min(), "high": part["p0"].max(), "ids": [part["id"].to_numpy(np.int64).tobytes()],
            "places": [part["p1"].to_numpy(np.float64).tobytes()], "vectors": [vectors.astype("f4" if single else "f8").tobytes()]})

    return placed.repartitionByRange(n, "p0", "id").mapInPandas(pack, _BLOCKS)


def _is_single(points: DataFrame) -> bool:
    """Whether vectors are stored in single precision, in which they also travel."""
    return points.schema["embedding"].dataType.elementType.typeName() == "float"


def _unpacked(block: pd.DataFrame, single: bool):
    """(ids, places, vectors) of a packed block."""
    ids, places, vectors = block.iloc[0, -3:]
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(places), np.frombuffer(vectors, "f4" if single else "f8").reshape(len(ids), -1)


def _block_links(left, right, eps: float, same: bool) -> pd.DataFrame:
    """One link for each vector of two blocks that is connected within them to one before it."""
    (ids, places, vectors), (other_ids, other_places, others) = left, right
    first = 0 if same else len(ids)  # positions of the second block follow those of the first
    positions = ids if same else np.concatenate([ids, other_ids])
    root = np.arange(len(positions))
    step = max(1, SCORES // max(1, len(other_ids)))
    for k in range(0, len(ids), step):
        reach = eps + ROUNDING * (eps + places[k:k + step][-1])
        start, stop = np.searchsorted(other_places, [places[k] - reach, places[k:k + step][-1] + reach])
        start = max(start, k) if same else start
        if start < stop:
            i, j = close_pairs(vectors[k:k + step], others[start:stop], eps)
            root = _roots(root, i + k, j + start + first)
    linked = root != np.arange(len(root))
    return pd.DataFrame({"a": positions[linked], "b": positions[root[linked]]})


def _roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position connected to each, after the links (a, b) join those that ``root`` holds so far."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            return root
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def components(links: DataFrame) -> DataFrame:
    """(id, root) with the smallest id of each component, for every id that has a link.

    Alternates two star steps: link everything around a vertex to the smallest id there,
    first outwards, then inwards, until the links no longer change.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        outward = both.join(smallest, "a").filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = outward.groupBy("a").agg(F.min("b").alias("m"))
        joined = outward.join(lowest, "a")
        inward = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut_lineage(inward.select("e.*").filter("a <> b").distinct())
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    stars = edges.groupBy("a").agg(F.min("b").alias("root"))
    return stars.select(F.col("a").alias("id"), "root").unionByName(
        stars.select(F.col("root").alias("id"), "root").distinct())


def density_clusters(points: DataFrame, eps: float = 0.3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, cluster): clusters numbered by their first member, -1 for lone vectors."""
    roots = cut_lineage(components(close_links(points, eps, block_rows)))
    numbers = ordered.row_numbers(roots.select("root").distinct(), [], "root", "n")
    labels = roots.join(numbers, "root").select("id", (F.col("n") - 1).alias("cluster"))
    return points.select("id").join(labels, "id", "left").select("id", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))
