"""Nearest neighbours by randomly rotated one-bit codes.

Index: a vector minus the sample's mean is turned by a random rotation and keeps one sign bit per dimension, with its length r
and the factor f = <code, direction>, the share of its direction that the code holds.  A query minus the mean is turned
alike and its entries are rounded to ``QUERY_BITS`` bits.  <code, query> is then a weighted sum of popcounts of the packed code
ANDed with the query's bit planes; divided by f it estimates the inner product of the directions without bias, with an error
that stays under ERROR * sqrt((1 - f^2) / f^2 / (D - 1)) but for about one pair in a thousand, plus what rounding adds at most.
That bounds each distance from below; a vector is compared exactly, in double precision, only where its bound is under the
k-th smallest distance known so far (at first from the sample, later from the task's own results).

The queries are a stated set: they meet all rows in blocks of ``QUERY_BLOCK``, one pass over the index per block, so data rows
are never shuffled and a task holds one block of queries and one slice of codes.  Each task returns its k best per query.
The mean, the first distances and nothing else come from a sample of ``SAMPLE`` rows; every row is indexed.  On the given
vectors cells of nearest centres would save little: half of them hold 94 of 100 neighbours.

Defined results: rows take no part if their vector is null, zero, empty, holds a null or non-finite entry or has another than the
commonest length.  A row with a null id is a candidate (last among ties) and no query.  All rows with the query's id are its own.  Repeated
rows are one query and several candidates; rows with one id and different vectors are a query each.  Fewer candidates than k give fewer rows; an empty table gives none; further columns
are ignored.  Distances above 1e150 can overflow.
"""
import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, stored
from .vectors import matrix, usual_width, with_vector

NEAREST, EVERY = 10, 100
SAMPLE = 2048
QUERY_BLOCK = 1 << 14
#: Code rows and queries whose estimates are held at once.
CODE_ROWS, QUERY_ROWS = 2048, 512
QUERY_BITS = 6
#: Standard deviations of the estimate's error that the bound allows for.
ERROR = 3.2
#: Room for single precision, in cosines and distances.
SLACK = 1e-5
SEED = 20


def rotation(width: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix for vectors padded to whole words of 64 bits."""
    padded = -(-width // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((padded, padded)))
    return (q * np.sign(np.diag(r)))[:width]


class Codes:
    """Packed signs, lengths and factors of vectors around a centre."""

    def __init__(self, bits: np.ndarray, lengths: np.ndarray, factors: np.ndarray):
        self.bits, self.lengths, self.factors = bits, lengths, factors

    @classmethod
    def of(cls, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> "Codes":
        away = vectors - centre
        # scaled first, so that very long vectors keep a finite length
        scale = np.maximum(np.abs(away).max(axis=1, initial=0), np.finfo(np.float64).tiny)
        turned = (away / scale[:, None]) @ turn
        lengths = np.sqrt((turned * turned).sum(axis=1))
        shares = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
        factors = np.divide(shares, lengths, out=np.ones_like(lengths), where=lengths > 0)
        return cls(np.packbits(turned > 0, axis=1).view(np.uint64), lengths * scale, factors)


class Queries:
    """A block of queries with their rounded entries in bit planes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, limits: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        self.ids, self.vectors, self.limits = ids, vectors, limits
        away = vectors - centre
        scale = np.maximum(np.abs(away).max(axis=1, initial=0), np.finfo(np.float64).tiny)
        turned = (away / scale[:, None]) @ turn
        lengths = np.sqrt((turned * turned).sum(axis=1))
        self.lengths = lengths * scale
        turned = np.divide(turned, lengths[:, None], out=np.zeros_like(turned), where=lengths[:, None] > 0)
        steps = (1 << QUERY_BITS) - 1
        self.low = turned.min(axis=1, initial=0)
        self.step = np.maximum((turned.max(axis=1, initial=0) - self.low) / steps, 1e-300)
        levels = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, steps).astype(np.uint8)
        self.planes = np.stack([np.packbits(levels >> bit & 1, axis=1).view(np.uint64) for bit in range(QUERY_BITS)])
        self.total = self.low * turned.shape[1] + self.step * levels.sum(axis=1)
        self.width = turned.shape[1]

    def least_distances(self, rows: slice, codes: Codes) -> np.ndarray:
        """Lower bounds of the squared distances of some queries to coded vectors, estimate less allowed error."""
        kind = np.float32 if self._moderate(codes) else np.float64
        ones = np.bitwise_count(codes.bits).sum(axis=1, dtype=np.int64).astype(kind)
        count = np.zeros((rows.stop - rows.start, len(codes.lengths)), kind)
        for bit in range(QUERY_BITS):
            for word in range(codes.bits.shape[1]):
                count += np.bitwise_count(self.planes[bit, rows, word, None] & codes.bits[None, :, word]) * kind(1 << bit)
        root, factors = np.sqrt(self.width), codes.factors
        low, step, total = (v[rows, None].astype(kind) for v in (self.low, self.step, self.total))
        # twice the sum over the code's ones less the sum of all entries, over root(D): the inner product with the code
        count *= 2 * step
        count += 2 * low * ones
        count -= total - kind(root * root / 2) * step  # and what rounding the query takes away at most
        count *= (1 / (root * factors)).astype(kind)
        count += (ERROR * np.sqrt(np.maximum(1 - factors ** 2, 0) / factors ** 2 / max(self.width - 1, 1)) + SLACK).astype(kind)
        np.minimum(count, 1, out=count)
        q, r = self.lengths[rows, None].astype(kind), codes.lengths.astype(kind)
        return (q - r) ** 2 + 2 * q * r * (1 - count)

    def _moderate(self, codes: Codes) -> bool:
        """Lengths whose products single precision holds."""
        lengths = np.concatenate([self.lengths, codes.lengths])
        lengths = lengths[lengths > 0]
        return len(lengths) == 0 or 1e-12 < lengths.min() and lengths.max() < 1e12


class Nearest:
    """The k nearest found so far of every query of a block: squared distance, then id with null last."""

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k = queries, k
        self.found = [[] for _ in queries.ids]
        self.limits = queries.limits.copy()
        self.compared = 0

    def add(self, ids: np.ndarray, known: np.ndarray, vectors: np.ndarray, codes: Codes):
        for start in range(0, len(self.queries.ids), QUERY_ROWS):
            rows = slice(start, min(start + QUERY_ROWS, len(self.queries.ids)))
            allowed = self.limits[rows] * (1 + SLACK) + 1e-9 * self.queries.lengths[rows] ** 2
            asked, candidate = np.nonzero(self.queries.least_distances(rows, codes) <= allowed[:, None])
            own = (ids[candidate] == self.queries.ids[start + asked]) & known[candidate]
            asked, candidate = asked[~own] + start, candidate[~own]
            self.compared += len(asked)
            distance = np.empty(len(asked))
            for at in range(0, len(asked), 1 << 16):
                part = slice(at, at + (1 << 16))
                apart = vectors[candidate[part]] - self.queries.vectors[asked[part]]
                distance[part] = (apart * apart).sum(axis=1)
            near = distance <= self.limits[asked] * (1 + 1e-9) + 1e-300
            asked, candidate, distance = asked[near], candidate[near], distance[near]
            order = np.lexsort((ids[candidate], ~known[candidate], distance, asked))
            asked, candidate, distance = asked[order], candidate[order], distance[order]
            cuts = np.flatnonzero(np.diff(asked)) + 1
            for group in np.split(np.arange(len(asked)), cuts):
                if len(group):
                    self._merge(int(asked[group[0]]), distance[group[:self.k]], ids[candidate[group[:self.k]]], known[candidate[group[:self.k]]])

    def _merge(self, query: int, distances, ids, known):
        rows = self.found[query] + list(zip(distances.tolist(), (~known).tolist(), ids.tolist()))
        self.found[query] = sorted(rows)[:self.k]
        if len(self.found[query]) == self.k:
            self.limits[query] = min(self.limits[query], self.found[query][-1][0])


class Plan:
    """What all tasks share: centre, rotation and sample, all bounded by SAMPLE rows and the width."""

    def __init__(self, sample: list, width: int):
        self.width, self.turn = width, rotation(width)
        self.sample_ids = np.array([r["id"] if r["id"] is not None else 0 for r in sample], np.int64)
        self.sample_known = np.array([r["id"] is not None for r in sample], bool)
        self.sample = np.array([r["vector"] for r in sample], np.float64).reshape(-1, width)
        self.centre = self.sample.mean(axis=0)

    def limits(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
        """The k-th smallest squared distance of each query within the sample, its own rows left out; infinite if there are fewer."""
        if len(self.sample) < k:
            return np.full(len(ids), np.inf)
        square = (vectors * vectors).sum(axis=1)[:, None] + (self.sample * self.sample).sum(axis=1)
        distance = np.maximum(square - 2 * vectors @ self.sample.T, 0) + 1e-12 * square  # never below the exact sum
        distance[(ids[:, None] == self.sample_ids) & self.sample_known] = np.inf
        return np.partition(distance, k - 1, axis=1)[:, k - 1]


def usable(embeddings: DataFrame) -> DataFrame:
    vectors = with_vector(embeddings, "vec_id", "embedding")
    return vectors.filter(F.exists("vector", lambda x: x != 0))


def index(vectors: DataFrame, plan: Plan) -> DataFrame:
    """Stored codes beside the vectors: id, vector, bits, length, factor."""

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                codes = Codes.of(matrix(batch.column(1), plan.width), plan.centre, plan.turn)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([b.tobytes() for b in codes.bits], pa.binary()),
                     pa.array(codes.lengths), pa.array(codes.factors)], ["id", "vector", "bits", "length", "factor"])

    schema = "id long, vector array<double>, bits binary, length double, factor double"
    return stored(vectors.mapInArrow(encode, schema), "one-bit-codes")


def _search_block(codes: DataFrame, plan: Plan, block: list, k: int) -> DataFrame:
    """The k nearest of every query of one block: query_id, rank, vec_id, score."""
    ids = np.array([r["id"] for r in block], np.int64)
    vectors = np.array([r["vector"] for r in block], np.float64).reshape(-1, plan.width)
    shared = codes.sparkSession.sparkContext.broadcast((ids, vectors))

    def search(batches):
        import pyarrow as pa

        ids, vectors = shared.value
        best = None
        for batch in batches:
            for at in range(0, batch.num_rows, CODE_ROWS):
                if best is None:
                    parts = [plan.limits(ids[s:s + QUERY_ROWS], vectors[s:s + QUERY_ROWS], k) for s in range(0, len(ids), QUERY_ROWS)]
                    best = Nearest(Queries(ids, vectors, np.concatenate(parts), plan.centre, plan.turn), k)
                part = batch.slice(at, CODE_ROWS)
                bits = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint64).reshape(part.num_rows, -1)
                coded = Codes(bits, part.column(3).to_numpy(), part.column(4).to_numpy())
                own = part.column(0)
                best.add(own.fill_null(0).to_numpy(), own.is_valid().to_numpy(zero_copy_only=False), matrix(part.column(1), plan.width), coded)
        if best is not None:
            rows = [(place, q, None if unknown else i, d)
                    for place, (q, found) in enumerate(zip(ids.tolist(), best.found)) for d, unknown, i in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int64()), pa.array(np.sqrt([r[3] for r in rows]), pa.float64())],
                ["place", "query_id", "vec_id", "score"])

    found = codes.mapInArrow(search, "place int, query_id long, vec_id long, score double")
    order = Window.partitionBy("place").orderBy("score", F.col("vec_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, every: int = EVERY, k: int = NEAREST, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest of every row whose id is divisible by ``every``, among all other rows."""
    none = embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = usable(embeddings)
    width = usual_width(vectors)
    if not width:
        return none
    vectors = vectors.filter(F.size("vector") == width)
    drawn = F.xxhash64("id", "vector")
    plan = Plan(vectors.orderBy(drawn, "id").limit(SAMPLE).collect(), width)
    codes = index(vectors, plan)
    asked = codes.filter(F.col("id") % every == 0).select("id", "vector").distinct()
    placed = ranked(asked, [F.col("id"), F.xxhash64("vector")], "at").withColumn("block", F.floor(F.col("at") / query_block))
    placed = stored(placed, "one-bit-queries")
    blocks = placed.agg(F.max("block")).first()[0]
    results = []
    for number in range(0 if blocks is None else blocks + 1):
        block = placed.filter(F.col("block") == number).select("id", "vector").collect()  # at most query_block rows
        found = _search_block(codes, plan, block, k)
        results.append(stored(found, "one-bit-found") if blocks else found)
    for found in results[1:]:
        results[0] = results[0].unionByName(found)
    return results[0] if results else none
