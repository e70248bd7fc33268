"""Exact vector matching of many queries against a reference set.

A reference set whose size is checked to fit is sent to every task once, and queries stream
past it without a shuffle.  A larger one is cut into tiles that meet blocks of queries in
bounded groups; for distances, into blocks along one dimension that meet the queries within reach.
All ways give the same rows, and only rows that qualify leave a task.
"""
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..session import cut_lineage

BROADCAST_BYTES = 64 << 20
#: The same for distances, where blocks seldom have to meet all queries.
DISTANCE_BYTES = 16 << 20
TILE_ROWS = 4096
#: Queries are dealt to as many times more tasks as there are this many references.
TASK_REFS = 8192
#: Scores of one slice of the references, 32 MB of them.
SCORES = 4_000_000
#: Large inputs take blocks of this many times ``TILE_ROWS``, as a block travels once per so many queries that meet it.
LARGE_BLOCKS = 4
#: Queries of a block, and references, compared at once.
STEP_ROWS = (256, 512)
#: Distances and places may differ by rounding as well.
ROUNDING = 1e-9


@dataclass(frozen=True)
class Pick:
    """Which (query, reference) pairs to keep.

    ``kind``: "range" keeps low < score < high, "top" the k best scores, "groups" one row per
    reference group with its best, sum and count.  Scores are cosines, or distances that count
    as better the smaller they are.
    """
    kind: str
    metric: str = "cosine"
    k: int = 1
    low: float = -np.inf
    high: float = np.inf


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors])


def score_matrix(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "distance":
        squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
        return np.sqrt(np.maximum(squares, 0.0))
    norms = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
    return np.divide(a @ b.T, norms, out=np.zeros((len(a), len(b))), where=norms > 0)


def close_pairs(a: np.ndarray, b: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all rows of ``a`` and ``b`` that are at most ``eps`` apart.

    One product of matrices gives minus half of all squared distances, in single precision where its rounding is small beside
    ``eps``.  What it can't decide is left to the distances themselves.  Vectors without finite squares are near none.
    """
    a, b = a.astype(np.float64, copy=False), b.astype(np.float64, copy=False)
    halves = [(m * m).sum(1) / 2 for m in (a, b)]
    finite = [np.flatnonzero(np.isfinite(h)) for h in halves]
    if len(finite[0]) < len(a) or len(finite[1]) < len(b):
        i, j = close_pairs(a[finite[0]], b[finite[1]], eps)
        return finite[0][i], finite[1][j]
    largest = 2 * max(halves[0].max(initial=0.0), halves[1].max(initial=0.0))

    def slack(kind):
        return 2 * (a.shape[1] + 8) * np.finfo(kind).eps * largest

    kind = np.float32 if slack(np.float32) < eps * eps / 8 else np.float64
    near = np.column_stack([a, -halves[0], np.ones(len(a))]).astype(kind) @ np.column_stack([b, np.ones(len(b)), -halves[1]]).astype(kind).T
    i, j = np.nonzero(near >= kind(-eps * eps / 2 - slack(kind)))
    unsure = np.flatnonzero(near[i, j] <= kind(-eps * eps / 2 + slack(kind)))
    kept = np.ones(len(i), dtype=bool)
    kept[unsure] = _distances(a, b, i[unsure], j[unsure]) <= eps
    return i[kept], j[kept]


def _distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distance of each pair of rows, of some pairs at a time."""
    out = np.empty(len(i))
    for k in range(0, len(i), TILE_ROWS):
        part = slice(k, k + TILE_ROWS)
        apart = a[i[part]] - b[j[part]]
        out[part] = np.sqrt((apart * apart).sum(1))
    return out


def _pick(query_ids, queries, ref_ids, groups, refs, pick: Pick) -> pd.DataFrame:
    """The picked pairs; references come in slices, so that a task holds at most ``SCORES`` scores at once."""
    step = max(1, SCORES // max(1, len(query_ids)))
    kept = None
    for k in range(0, len(ref_ids), step):
        part = slice(k, k + step)
        found = _pick_slice(query_ids, queries, ref_ids[part], groups[part], refs[part], pick)
        kept = found if kept is None else _join_slices(kept, found, pick)
    return kept


def _join_slices(kept, found, pick: Pick) -> pd.DataFrame:
    both = pd.concat([kept, found])
    if pick.kind == "groups":
        return both.groupby(["query_id", "ref_group"], sort=False, as_index=False).agg({"best": "max", "total": "sum", "n": "sum"})
    if pick.kind == "top":
        order = both.sort_values(["query_id", "score", "ref_id"], ascending=[True, pick.metric == "distance", True])
        return order.groupby("query_id", sort=False).head(pick.k)
    return both


def _pick_slice(query_ids, queries, ref_ids, groups, refs, pick: Pick) -> pd.DataFrame:
    if pick.kind == "range" and pick.metric == "distance":
        i, j = close_pairs(queries, refs, pick.high)
        score = _distances(queries, refs, i, j)
        inside = (score > pick.low) & (score < pick.high)
        return pd.DataFrame({
            "query_id": query_ids[i[inside]], "ref_id": ref_ids[j[inside]], "ref_group": groups[j[inside]], "score": score[inside]})
    scores = score_matrix(queries, refs, pick.metric)
    if pick.kind == "groups":
        parts = []
        for group in np.unique(groups):
            own = scores[:, groups == group]
            parts.append(pd.DataFrame({
                "query_id": query_ids, "ref_group": group, "best": own.max(1), "total": own.sum(1), "n": own.shape[1]}))
        return pd.concat(parts)
    if pick.kind == "range":
        i, j = np.nonzero((scores > pick.low) & (scores < pick.high))
    else:
        by = scores if pick.metric == "distance" else -scores
        k = min(pick.k, by.shape[1])
        # all as good as the k-th, then the smaller ids among equals
        i, j = np.nonzero(by <= np.partition(by, k - 1, axis=1)[:, k - 1:k])
        order = np.lexsort((ref_ids[j], by[i, j], i))
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[place < k], j[place < k]
    return pd.DataFrame({
        "query_id": query_ids[i], "ref_id": ref_ids[j], "ref_group": groups[j], "score": scores[i, j]})


_SCHEMA = {
    "groups": "query_id long, ref_group long, best double, total double, n long",
    "range": "query_id long, ref_id long, ref_group long, score double",
    "top": "query_id long, ref_id long, ref_group long, score double",
}


def match(queries: DataFrame, refs: DataFrame, pick: Pick, limit_bytes: int = BROADCAST_BYTES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Match ``queries(id, embedding)`` against ``refs(id, ref_group, embedding)``."""
    size = refs.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    if size["n"] == 0:
        return queries.sparkSession.createDataFrame([], _SCHEMA[pick.kind])
    by_reach = pick.metric == "distance" and (pick.kind == "range" or pick.kind == "top" and pick.k == 1)
    if size["n"] * size["width"] * 8 <= (min(limit_bytes, DISTANCE_BYTES) if by_reach else limit_bytes):
        return _match_broadcast(queries, refs, pick)
    if by_reach:
        return _match_blocks(queries, refs, pick, tile_rows)
    return _merge(_match_tiles(queries, refs, size["n"], pick, tile_rows), pick)


def _match_broadcast(queries, refs, pick):
    rows = refs.select("id", "ref_group", "embedding").orderBy("id").toPandas()  # size checked by the caller
    shared = queries.sparkSession.sparkContext.broadcast(
        (rows["id"].to_numpy(np.int64), rows["ref_group"].to_numpy(np.int64), _matrix(rows["embedding"])))

    def run(batches):
        ids, groups, vectors = shared.value
        for batch in batches:
            if len(batch):
                yield _pick(batch["id"].to_numpy(), _matrix(batch["embedding"]), ids, groups, vectors, pick)

    asked = queries.select("id", "embedding")
    if len(rows) > TASK_REFS:  # a query costs a score per reference, which its few bytes do not show
        asked = asked.repartition(queries.sparkSession.sparkContext.defaultParallelism * -(-len(rows) // TASK_REFS), "id")
    return asked.mapInPandas(run, _SCHEMA[pick.kind])


def _match_tiles(queries, refs, n_refs, pick, tile_rows):
    n_tiles = -(-n_refs // tile_rows)
    n_blocks = max(1, -(-queries.count() // tile_rows))

    def slot(n):
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.select("id", "embedding", slot(n_blocks).alias("block")).select("*", every(n_tiles).alias("tile"))
    right = refs.select("id", "ref_group", "embedding", slot(n_tiles).alias("tile")).select("*", every(n_blocks).alias("block"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c.split()[0]: [] for c in _SCHEMA[pick.kind].split(", ")})
        b = b.sort_values("id")
        return _pick(a["id"].to_numpy(), _matrix(a["embedding"]), b["id"].to_numpy(), b["ref_group"].to_numpy(),
                     _matrix(b["embedding"]), pick)

    return left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInPandas(run, _SCHEMA[pick.kind])


def _merge(found, pick):
    """Put the tiles' answers together."""
    if pick.kind == "range":
        return found
    if pick.kind == "groups":
        return found.groupBy("query_id", "ref_group").agg(
            F.max("best").alias("best"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    best = F.col("score").asc() if pick.metric == "distance" else F.col("score").desc()
    order = Window.partitionBy("query_id").orderBy(best, "ref_id")  # k rows per query and tile
    return found.withColumn("_p", F.row_number().over(order)).filter(F.col("_p") <= pick.k).drop("_p")


# ---------------------------------------------------------------- distances, in blocks

def _finite(vector) -> Column:
    """Whether the squares of a vector are finite; others are near none."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < 1e150)), F.lit(False))


def _match_blocks(queries, refs, pick, block_rows):
    """The nearest reference of each query, or all within a distance, without a look at blocks out of reach.

    References are sorted into blocks along the dimension in which they differ most; vectors are at least as far apart as
    they are in it.  A query meets the block at its own place first, then those within the distance found there.
    """
    usable = refs.filter(F.col("id").isNotNull() & _finite("embedding")).select("id", "ref_group", "embedding")
    if pick.kind == "top":  # of copies the one with the smallest id is the nearest
        usable = usable.groupBy("embedding").agg(F.min(F.struct("id", "ref_group")).alias("m")).select("m.*", "embedding")
    usable = cut_lineage(usable)
    spreads = usable.select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.var_pop("x").alias("spread"))
    widest = spreads.orderBy(F.desc("spread"), "dim").first()
    if widest is None:
        return queries.sparkSession.createDataFrame([], _SCHEMA[pick.kind])
    n = usable.count()
    rows = min(LARGE_BLOCKS * block_rows, max(block_rows, n // 10))
    single = usable.schema["embedding"].dataType.elementType.typeName() == "float"
    place = F.get("embedding", F.lit(widest["dim"])).cast("double")
    blocks = cut_lineage(_packed_refs(usable.withColumn("place", place), -(-n // rows), rows, single))
    bounds = blocks.select("block", "low", "high").orderBy("block").collect()  # a few numbers per block
    numbers, lows, highs = (np.array([r[c] for r in bounds]) for c in ("block", "low", "high"))

    def within(places, reach):
        """Numbers of the blocks that have places at most ``reach`` away."""
        reach = reach + ROUNDING * (reach + np.abs(places))
        first, stop = np.searchsorted(highs, places - reach, "left"), np.searchsorted(lows, places + reach, "right")
        return [numbers[i:j] for i, j in zip(first, stop)]

    asked = queries.filter(_finite("embedding")).select("id", "embedding", place.alias("place"))
    if pick.kind == "range":
        @F.pandas_udf("array<long>")
        def touched(places: pd.Series) -> pd.Series:
            return pd.Series(within(places.to_numpy(), pick.high))

        return _meet(asked.withColumn("block", F.explode(touched("place"))), blocks, rows, single, _SCHEMA["range"],
                     lambda block, left, right: _in_reach(left, right, pick))

    @F.pandas_udf("long")
    def at_home(places: pd.Series) -> pd.Series:
        return pd.Series(numbers[np.maximum(np.searchsorted(lows, places.to_numpy(), "right") - 1, 0)])

    vector = "array<float>" if single else "array<double>"

    def first(block, left, right):
        found = _nearest(left, right, np.full(len(left), np.inf))
        places = left["place"].to_numpy()
        found["more"] = [[int(k) for k in near if k != block] for near in within(places, found["score"].to_numpy())]
        found["place"] = places
        found["embedding"] = [v if more else None for v, more in zip(left["embedding"], found["more"])]
        return found

    def next_(block, left, right):
        found = _nearest(left, right, left["score"].to_numpy())
        return found.assign(row=left["row"].to_numpy()).dropna(subset="ref_id")

    found = cut_lineage(_meet(asked.withColumn("block", at_home("place")), blocks, rows, single,
                              f"{_SCHEMA['top']}, more array<long>, place double, embedding {vector}", first))
    found = found.withColumn("row", F.monotonically_increasing_id())  # of rows that are stored
    answers = found.select("row", *[c.split()[0] for c in _SCHEMA["top"].split(", ")])
    if len(bounds) > 1:
        again = found.filter(F.size("more") > 0).select(
            "row", F.col("query_id").alias("id"), "place", "embedding", "score", F.explode("more").alias("block"))
        answers = answers.unionByName(_meet(again, blocks, rows, single, f"row long, {_SCHEMA['top']}", next_))
    best = answers.groupBy("row", "query_id").agg(F.min(F.struct("score", "ref_id", "ref_group")).alias("b"))
    return best.select("query_id", "b.ref_id", "b.ref_group", "b.score")


def _packed_refs(placed: DataFrame, n: int, rows: int, single: bool) -> DataFrame:
    """Blocks of at most ``rows`` references next to each other by place, each packed into one row; numbers follow places."""
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
        return pd.DataFrame({
            "block": [k], "low": part["place"].min(), "high": part["place"].max(), "places": [part["place"].to_numpy(np.float64).tobytes()],
            "ids": [part["id"].to_numpy(np.int64).tobytes()], "groups": [part["ref_group"].to_numpy(np.int64).tobytes()],
            "vectors": [_matrix(part["embedding"]).astype("f4" if single else "f8").tobytes()]})

    return placed.repartitionByRange(n, "place", "id").sortWithinPartitions("place", "id").mapInPandas(
        pack, "block long, low double, high double, places binary, ids binary, groups binary, vectors binary")


def _meet(asked: DataFrame, blocks: DataFrame, rows: int, single: bool, schema: str, look) -> DataFrame:
    """``look(block, queries, refs)`` of each block and its queries, of about ``rows`` queries at a time."""
    counts = asked.groupBy("block").agg(F.ceil(F.count("*") / rows).cast("long").alias("parts")).collect()
    parts = F.broadcast(asked.sparkSession.createDataFrame([tuple(r) for r in counts], "block long, parts long"))  # a row per block
    left = asked.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("id", "place"), F.col("parts"))).drop("parts")
    right = blocks.join(parts, "block").select(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "places", "ids", "groups", "vectors")

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in names})
        ids = np.frombuffer(b["ids"].iloc[0], np.int64)
        refs = (np.frombuffer(b["places"].iloc[0]), ids, np.frombuffer(b["groups"].iloc[0], np.int64),
                np.frombuffer(b["vectors"].iloc[0], "f4" if single else "f8").reshape(len(ids), -1).astype(np.float64))
        return look(key[0], a.sort_values(["place", "id"], ignore_index=True), refs)[names]

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(run, schema)


def _in_reach(left: pd.DataFrame, right, pick: Pick) -> pd.DataFrame:
    """The picked pairs of a block, of queries near each other with the references about them."""
    ref_places, ref_ids, groups, refs = right
    ids, places, vectors = left["id"].to_numpy(), left["place"].to_numpy(), _matrix(left["embedding"])
    found = []
    for k in range(0, len(ids), STEP_ROWS[0]):
        some = slice(k, k + STEP_ROWS[0])
        reach = pick.high + ROUNDING * (pick.high + np.abs(places[some]).max())
        start = np.searchsorted(ref_places, places[some][0] - reach, "left")
        part = slice(start, np.searchsorted(ref_places, places[some][-1] + reach, "right"))
        found.append(_pick(ids[some], vectors[some], ref_ids[part], groups[part], refs[part], pick) if part.start < part.stop else None)
    none = pd.DataFrame({c.split()[0]: [] for c in _SCHEMA["range"].split(", ")})
    return pd.concat([f for f in found if f is not None] or [none])


def _nearest(left: pd.DataFrame, right, best: np.ndarray) -> pd.DataFrame:
    """The nearest reference of each query, the smaller id among equals; null where none is as near as ``best``.

    Products of matrices rule out most pairs of a step; what their rounding can't decide is left to the distances themselves.
    """
    ref_places, ref_ids, groups, refs = right
    places, vectors = left["place"].to_numpy(), _matrix(left["embedding"])
    middle = refs.mean(0)  # small numbers round less
    a, b = vectors - middle, refs - middle
    squares, ref_squares = (a * a).sum(1), (b * b).sum(1)
    best, at = best.astype(np.float64), np.full(len(places), -1)
    starts = np.arange(0, len(refs), STEP_ROWS[1])
    lows, highs = ref_places[starts], ref_places[np.minimum(starts + STEP_ROWS[1], len(refs)) - 1]
    for k in range(0, len(places), STEP_ROWS[0]):
        own = np.arange(k, min(k + STEP_ROWS[0], len(places)))
        gaps = np.maximum(np.maximum(lows - places[own][:, None], places[own][:, None] - highs), 0)
        for t in np.argsort(gaps.min(0), kind="stable"):
            i = own[gaps[:, t] <= best[own] * (1 + ROUNDING)]
            if not len(i):
                continue
            part = np.arange(starts[t], min(starts[t] + STEP_ROWS[1], len(refs)))
            near = squares[i][:, None] + ref_squares[part] - 2.0 * a[i] @ b[part].T
            slack = 4 * (a.shape[1] + 8) * np.finfo(float).eps * (squares[i] + ref_squares[part].max())
            p, q = np.nonzero(near <= np.minimum(near.min(1) + 2 * slack, best[i] ** 2 * (1 + ROUNDING) + slack)[:, None])
            p, q = i[p], part[q]
            apart = _distances(vectors, refs, p, q)
            order = np.lexsort((ref_ids[q], apart, p))
            p, q, apart = p[order], q[order], apart[order]
            p, only = np.unique(p, return_index=True)
            q, apart = q[only], apart[only]
            nearer = (apart < best[p]) | (apart == best[p]) & ((at[p] < 0) | (ref_ids[q] < ref_ids[at[p]]))
            best[p[nearer]], at[p[nearer]] = apart[nearer], q[nearer]
    met = at >= 0
    return pd.DataFrame({
        "query_id": left["id"], "ref_id": pd.Series(ref_ids[at], dtype="Int64").where(met),
        "ref_group": pd.Series(groups[at], dtype="Int64").where(met), "score": best})


# ------------------------------------------------------------------- finding operators

def most_similar(queries: DataFrame, exemplars: DataFrame, k: int = 5) -> DataFrame:
    return match(queries, exemplars, Pick("top", k=k))


def context_boost(best: Column) -> Column:
    return F.when(best > 0.9, 0.2).when(best > 0.8, 0.15).when(best > 0.7, 0.1).when(best > 0.6, 0.05).otherwise(0.0)


def exemplar_findings(queries: DataFrame, exemplars: DataFrame, top: int = 3) -> DataFrame:
    """Findings for queries close to a known example, raised by closeness to its whole type."""
    hits = match(queries, exemplars, Pick("top", k=top)).filter(F.col("score") > 0.75)
    per_type = match(queries, exemplars, Pick("groups")).select(
        "query_id", "ref_group", "best", (F.col("total") / F.col("n")).alias("mean"))
    joined = hits.join(per_type, ["query_id", "ref_group"], "left")
    confidence = F.least(F.col("score") + context_boost(F.coalesce("best", F.lit(0.0))), F.lit(0.95))
    found = joined.withColumn("confidence", confidence).filter(F.col("confidence") > 0.7)
    return found.select(
        "query_id", "ref_id", "ref_group", F.col("score").alias("similarity"), "best", "mean", "confidence",
        F.coalesce(F.col("best") > 0.7, F.lit(False)).alias("similar_to_known"))


def first_match(queries: DataFrame, exemplars: DataFrame, over: float = 0.7) -> DataFrame:
    """The first exemplar (by id) a query is similar to, if any."""
    hits = match(queries, exemplars, Pick("range", low=over))
    return hits.groupBy("query_id").agg(F.min_by(F.struct("ref_id", "score"), "ref_id").alias("m")).select(
        "query_id", "m.ref_id", F.col("m.score").alias("confidence"))


def pattern_evolution(queries: DataFrame, known: DataFrame, mutations: DataFrame) -> DataFrame:
    """Queries similar but not equal to a known pattern and unlike its recorded mutations.

    ``mutations.ref_group`` is the id of the base pattern.
    """
    near = match(queries, known, Pick("range", low=0.6, high=0.9))
    repeats = match(queries, mutations, Pick("range", low=0.95)).select("query_id", F.col("ref_group").alias("ref_id")).distinct()
    counts = mutations.groupBy(F.col("ref_group").alias("ref_id")).agg(F.count("*").alias("recorded"))
    fresh = near.join(repeats, ["query_id", "ref_id"], "left_anti").join(counts, "ref_id", "left")
    return fresh.select(
        "query_id", "ref_id", F.col("score").alias("similarity"), F.coalesce("recorded", F.lit(0)).alias("recorded"),
        F.lit(-0.6).alias("anomaly_score"), F.lit(0.7).alias("confidence"))


def type_key(kind: Column) -> Column:
    key = F.replace(F.lower(kind), F.lit(" "), F.lit("_"))
    for part, name in reversed(fixed.TYPE_KEYS):
        key = F.when(F.contains(kind, F.lit(part)), name).otherwise(key)
    return key


def cache_misses(rows: DataFrame, cache: DataFrame, key: str = "code_key") -> DataFrame:
    """Distinct rows whose key is not cached yet: the only ones a model has to see."""
    return rows.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def embed(rows: DataFrame, load_model, text: str = "code") -> DataFrame:
    """Add ``embedding`` with a model that is loaded once per task.

    ``load_model()`` returns a function from a list of texts to a list of vectors.
    """
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for batch in batches:
            if model is None and len(batch):  # a task without texts loads nothing
                model = load_model()
            yield pd.Series([list(map(float, v)) for v in model(batch.tolist())] if len(batch) else [])
    return rows.withColumn("embedding", run(F.col(text)))


def hashed_embedder(width: int = 64):
    """A model without weights: how often words fall into each of ``width`` buckets of a digest."""
    import hashlib
    import re

    words = re.compile(r"\w+")

    def vectors(texts):
        out = []
        for text in texts:
            v = [0.0] * width
            for w in words.findall((text or "").lower()):
                v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % width] += 1.0
            out.append(v)
        return out

    return vectors


def embed_through_cache(rows: DataFrame, path: str, load_model=hashed_embedder, text: str = "code", key: str = "code_key") -> DataFrame:
    """``rows`` with ``embedding`` from the cache table at ``path``; what it lacks is embedded once and written back first."""
    from ..sources.stored import folder_exists

    spark, schema = rows.sparkSession, f"`{key}` string, embedding array<float>"
    known = spark.read.schema(schema).parquet(path) if folder_exists(spark, path) else spark.createDataFrame([], schema)
    missing = cache_misses(rows.filter(F.col(key).isNotNull()).select(key, text), known, key)
    embed(missing, load_model, text).select(key, "embedding").write.mode("append").parquet(path)
    return rows.join(spark.read.schema(schema).parquet(path), key, "left")
