"""Embedding whitening from a bit-sliced scatter matrix.

Every entry c becomes the integer x = floor(1024 c) + 100000.  A task takes rows in slices; in a slice each dimension is
shifted by its smallest value there and its bits are laid out in planes: one word holds one bit of 64 rows.  The sum of
x_a x_b over the slice is the sum of 2**(i + j) popcount(plane i of a AND plane j of b), and the sum of x_a that of 2**i
popcount(plane i of a), so both are exact whatever the order of rows.  Slice sums leave a task as digits of 32 bits,
which Spark adds as longs; the driver receives one row per pair of dimensions, never a vector.  There they are
put together, centred as integers (n Q_ab - S_a S_b) and only then divided for ``eigh``.  A second pass projects the rows.

Defined results: a row is left out if its vector is null, holds a null or non-finite entry, has no entries, or has another than the
commonest length (the longer of two as common); floor(1024 c) is held to +-2**62; a null id stays; repeated rows each
count and each return; equal eigenvalues leave the choice of their vectors to ``eigh``.  Where an eigenvalue is zero (no spread
in that direction, one row, all rows equal) ``whitened`` is null, and ``explained`` is null if there is no spread at all;
``identity_error`` speaks of the other components and is null without any.  ``deviation`` is null where a long cannot hold it,
``deviation_exact`` has it as a decimal of 38 digits (null beyond).  An empty table gives an empty result.  Further columns are ignored.
"""
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import matrix, usual_width, with_vector

SCALE, OFFSET, LIMIT = 1024, 100_000, 1 << 62
COMPONENTS = 8
#: Rows whose bit planes are held at once.
SLICE = 1 << 15
#: Words of a plane that are compared with all others at a time.
WORDS = 64
#: A pair's sum over a task takes 2 * 63 bits and the rows' count; the last digit carries the sign.
DIGITS = 6


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 as int64."""
    scaled = np.floor(SCALE * vectors)
    low, high = scaled < -float(LIMIT), scaled >= float(LIMIT)
    x = np.where(low | high, 0, scaled).astype(np.int64)
    return np.where(high, LIMIT, np.where(low, -LIMIT, x)) + OFFSET


def planes_of(y: np.ndarray):
    """Bit planes of non-negative integers: (plane, word) with the dimension and the weight's exponent of each plane."""
    rows, width = y.shape
    words = -(-rows // 64)
    planes, dims, shifts = [], [], []
    for d in range(width):
        column = np.ascontiguousarray(y[:, d])
        for bit in range(int(column.max()).bit_length()):
            packed = np.zeros(8 * words, np.uint8)
            bits = np.packbits((column >> np.uint64(bit)) & np.uint64(1) == 1, bitorder="little")
            packed[:len(bits)] = bits
            planes.append(packed.view("<u8"))
            dims.append(d)
            shifts.append(bit)
    stack = np.stack(planes) if planes else np.zeros((0, words), np.uint64)
    return stack, np.array(dims, np.int64), np.array(shifts, np.int64)


def common_ones(plane: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Rows that a plane shares with each of the others, by AND and popcount."""
    counts = np.zeros(len(others), np.int64)
    for at in range(0, len(plane), WORDS):
        counts += np.bitwise_count(others[:, at:at + WORDS] & plane[at:at + WORDS]).sum(axis=1, dtype=np.int64)
    return counts


def slice_sums(x: np.ndarray):
    """(rows, sums of x_a, sums of x_a x_b) as Python integers in object arrays."""
    rows, width = x.shape
    least = x.min(axis=0)
    planes, dims, shifts = planes_of(x.astype(np.uint64) - least.astype(np.uint64))  # wraps back to the difference
    own = np.zeros(width, object)
    product = np.zeros((width, width), object)
    weight = np.array([1 << int(s) for s in shifts], object)
    small = len(shifts) == 0 or int(shifts.max()) + rows.bit_length() < 62
    weights = weight.astype(np.int64) if small else weight
    first = np.searchsorted(dims, np.arange(width))
    for k, a in enumerate(dims.tolist()):
        begin = int(first[a])
        counts = common_ones(planes[k], planes[begin:])
        own[a] += weight[k] * int(counts[k - begin])
        sums = np.zeros(width, weights.dtype)
        np.add.at(sums, dims[begin:], weights[begin:] * counts)
        product[a] += weight[k] * sums.astype(object)
    product = np.triu(product) + np.triu(product, 1).T
    base = np.array([int(v) for v in least], object)
    # sums of x_a = y_a + m_a and of (y_a + m_a)(y_b + m_b)
    return rows, own + rows * base, product + np.outer(base, own) + np.outer(own, base) + rows * np.outer(base, base)


def digits(value: int) -> list[int]:
    out = []
    for _ in range(DIGITS - 1):
        out.append(value & 0xFFFFFFFF)
        value >>= 32
    return [*out, value]


def scatter(vectors: DataFrame, width: int) -> DataFrame:
    """Exact sums as (a, b, d0 ...): a row per pair a <= b of dimensions, and (-1, a) for sums, (-1, -1) for the rows."""
    names = [f"d{k}" for k in range(DIGITS)]

    def collect(batches):
        import pyarrow as pa

        rows, sums, products, held, size = 0, np.zeros(width, object), np.zeros((width, width), object), [], 0

        def fold():
            nonlocal rows, sums, products, held, size
            n, s, q = slice_sums(np.concatenate(held))
            rows, sums, products, held, size = rows + n, sums + s, products + q, [], 0

        for batch in batches:
            if batch.num_rows:
                x = integers(matrix(batch.column(0), width))
                for at in range(0, len(x), SLICE):
                    held.append(x[at:at + SLICE])
                    size += len(held[-1])
                    if size >= SLICE:
                        fold()
        if held:
            fold()
        if rows:
            values = [(-1, -1, rows), *((-1, a, sums[a]) for a in range(width))]
            values += [(a, b, products[a, b]) for a in range(width) for b in range(a, width)]
            cut = [digits(int(v)) for _, _, v in values]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v[0] for v in values], pa.int32()), pa.array([v[1] for v in values], pa.int32())]
                + [pa.array([c[k] for c in cut], pa.int64()) for k in range(DIGITS)], ["a", "b", *names])

    found = vectors.select("vector").mapInArrow(collect, "a int, b int, " + ", ".join(f"{n} long" for n in names))
    return found.groupBy("a", "b").agg(*[F.sum(n).alias(n) for n in names])


class Whitening:
    """The fitted transformation: n, sums, unit eigenvectors by falling eigenvalue, and the covariance's trace."""

    def __init__(self, n: int, sums: list, products: dict, components: int):
        width = len(sums)
        centred = np.zeros((width, width), object)
        for (a, b), q in products.items():
            centred[a, b] = centred[b, a] = n * q - sums[a] * sums[b]
        square = n * n
        covariance = np.array([[int(c) / square for c in row] for row in centred], np.float64).reshape(width, width)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        self.n, self.sums = n, sums
        self.trace = int(sum(centred[a, a] for a in range(width))) / square
        self.values, self.vectors = values[order], vectors[:, order]
        self.defined = self.values > width * np.finfo(np.float64).eps * max(self.trace, 0.0)
        scaled = self.vectors[:, self.defined] / np.sqrt(self.values[self.defined])
        error = np.abs(scaled.T @ covariance @ scaled - np.eye(scaled.shape[1]))
        self.identity_error = float(error.max()) if error.size else None
        self.scaled = np.zeros_like(self.vectors)
        self.scaled[:, self.defined] = scaled

    def deviations(self, x: np.ndarray):
        """n x - S, as int64 where that holds it, else as Python integers."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, *(abs(s) for s in self.sums))
        if most < 1 << 61:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)


def exact_squares(deviation: np.ndarray) -> list[int]:
    """Sums of squares over the dimensions, exact."""
    if deviation.dtype != object and len(deviation):
        if int(np.abs(deviation).max(initial=0)) ** 2 * deviation.shape[1] < 1 << 63:
            return (deviation * deviation).sum(axis=1).tolist()
        deviation = deviation.astype(object)
    return [int(v) for v in (deviation * deviation).sum(axis=1)]


def fit(vectors: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """``vectors`` has the columns id and vector, all of ``width`` entries; None for no rows."""
    found = {}
    for row in scatter(vectors, width).collect():  # bounded by the square of the width
        found[row["a"], row["b"]] = sum(row[f"d{k}"] << (32 * k) for k in range(DIGITS))
    if not found:
        return None
    sums = [found[-1, a] for a in range(width)]
    return Whitening(found[-1, -1], sums, {p: q for p, q in found.items() if p[0] >= 0}, components)


OUTPUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
          "deviation_exact decimal(38,0)")


def project(vectors: DataFrame, width: int, fitted: Whitening) -> DataFrame:
    """A row per vector and component."""

    def rows(batches):
        from decimal import Context, Decimal

        import pyarrow as pa

        kinds, exact = [f.dataType for f in schema.fields], Context(prec=100)
        count = len(fitted.values)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                x = integers(matrix(part.column(1), width))
                deviation = fitted.deviations(x)
                squares = exact_squares(deviation)
                # at least double precision: the integers are exact, one division follows
                centred = (deviation / fitted.n).astype(np.float64)
                whitened = centred @ fitted.scaled
                repeat = np.repeat(np.arange(len(x)), count)
                explained = fitted.values / fitted.trace if fitted.trace > 0 else [None] * count
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(repeat)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(repeat), fitted.n, np.int64)),
                    pa.array([s if s < 1 << 63 else None for s in squares], pa.int64()).take(pa.array(repeat)),
                    pa.array(whitened.ravel(), mask=~np.tile(fitted.defined, len(x))),
                    pa.array([*explained] * len(x), pa.float64()),
                    pa.array([fitted.identity_error] * len(repeat), pa.float64()),
                    pa.array([exact.create_decimal(s) if s < 10 ** 38 else None for s in squares], pa.decimal128(38, 0)).take(pa.array(repeat)),
                ], [f.name for f in schema.fields])

    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(OUTPUT)
    return vectors.select("id", "vector").mapInArrow(rows, schema)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row."""
    spark = embeddings.sparkSession
    vectors = with_vector(embeddings, "vec_id", "embedding").filter(F.size("vector") > 0)
    width = usual_width(vectors)
    vectors = vectors.filter(F.size("vector") == width)
    fitted = fit(vectors, width, components) if width else None
    return project(vectors, width, fitted) if fitted else spark.createDataFrame([], OUTPUT)
