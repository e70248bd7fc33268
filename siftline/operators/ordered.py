"""Order-dependent operators that never put a whole key into one task.

``lag``, running totals and row numbers over one large key would sort that key in a
single task.  Here the order column (an integer, unique per key, or null on one row) is cut into
blocks of ``block`` values; windows run inside a block, and one summary row per block is
carried across blocks.  Where the order column is sparse, such as a hash, most blocks hold one row and
the summary is as long as the input, so it is cut the same way, by blocks of blocks, until few are left: a
window never holds more than ``block`` rows, whatever the spacing.  The smallest and largest value tell how
often to cut; a column that spans less than a block needs one window and no join.
"""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20


def _beside(left: DataFrame, right: DataFrame, keys: list, how: str = "inner") -> DataFrame:
    """Join on keys where null equals null, keeping the left columns and the right's other ones."""
    named = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return left.join(named, condition, how).drop(*[f"_k_{k}" for k in keys])


def _blocked(df: DataFrame, seq: str, block: int, name: str) -> DataFrame:
    return df.withColumn(name, F.floor(F.col(seq) / F.lit(block)).cast("long"))


def _levels(df: DataFrame, seq: str, block: int) -> int:
    """How often the order column must be cut until at most ``block`` different values are left."""
    low, high = df.agg(F.min(seq), F.max(seq)).first()
    levels = 0
    while low is not None and high - low >= block:
        low, high, levels = low // block, high // block, levels + 1
    return levels


def _sums_before(df: DataFrame, keys: list, seq: str, names: list, block: int, levels: int) -> DataFrame:
    """Adds ``_o_name``: the total of ``name`` over all earlier rows of the key, 0 for the first."""
    if levels == 0:
        before = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_o_{n}") for n in names])
    own = f"_block{levels}"
    blocked = _blocked(df, seq, block, own)
    totals = blocked.groupBy(*keys, own).agg(*[F.sum(n).alias(n) for n in names])
    offsets = _sums_before(totals, keys, own, names, block, levels - 1).drop(*names)
    before = Window.partitionBy(*keys, own).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    inside = blocked.select("*", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_i_{n}") for n in names])
    joined = _beside(inside, offsets, [*keys, own])
    return joined.select(*[F.col(c) for c in df.columns], *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(f"_o_{n}") for n in names])


def running_sums(df: DataFrame, keys: list, seq: str, sums: dict, block: int = BLOCK) -> DataFrame:
    """Adds, for each ``name: column`` in ``sums``, the inclusive running total by ``seq``."""
    valued = df.select("*", *[F.col(c).alias(f"_v_{n}") if isinstance(c, str) else c.alias(f"_v_{n}") for n, c in sums.items()])
    before = _sums_before(valued, keys, seq, [f"_v_{n}" for n in sums], block, _levels(df, seq, block))
    return before.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_o__v_{n}") + F.coalesce(F.col(f"_v_{n}"), F.lit(0))).alias(n) for n in sums],
    )


def row_numbers(df: DataFrame, keys: list, seq: str, name: str = "row_no", block: int = BLOCK) -> DataFrame:
    """1-based position by ``seq`` within the keys."""
    return running_sums(df, keys, seq, {name: F.lit(1).cast("long")}, block)


def _with_previous(df: DataFrame, keys: list, seq: str, value: str, name: str, block: int, levels: int) -> DataFrame:
    """Adds ``value`` of the row before, null for the first row of a key."""
    if levels == 0:
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(seq)))
    own = f"_block{levels}"
    blocked = _blocked(df, seq, block, own)
    within = blocked.withColumn("_prev", F.lag(value).over(Window.partitionBy(*keys, own).orderBy(seq)))
    # rows without a place come first, in a block of their own
    last = blocked.groupBy(*keys, own).agg(F.max_by(value, F.coalesce(F.col(seq), F.lit(0))).alias("_last"))
    carried = _with_previous(last, keys, own, "_last", "_carried", block, levels - 1).drop("_last")
    joined = _beside(within, carried, [*keys, own])
    return joined.select(*[F.col(c) for c in df.columns], F.coalesce("_prev", "_carried").alias(name))


def previous_values(df: DataFrame, keys: list, seq: str, values: dict, block: int = BLOCK) -> DataFrame:
    """Adds, for each ``name: column``, its value on the previous row of the same key."""
    packed = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    found = _with_previous(df.withColumn("_packed", packed), keys, seq, "_packed", "_before", block, _levels(df, seq, block))
    return found.select(*[F.col(c) for c in df.columns], *[F.col("_before")[n].alias(n) for n in values])


def gap_to_next(df: DataFrame, keys: list, at: str, name: str, limit: int, bucket: int = 1 << 20) -> DataFrame:
    """Adds the distance to the next row's ``at`` when it is below ``limit``, else null.

    Only rows of the same or the next ``bucket`` can lie within ``limit``, so a key is
    split by bucket and needs one extra row per bucket from its neighbour.
    """
    if bucket < limit:
        raise ValueError("the bucket must not be smaller than the limit")
    cut = df.withColumn("_bucket", F.floor(F.col(at) / F.lit(bucket)).cast("long"))
    firsts = cut.groupBy(*keys, "_bucket").agg(F.min(at).alias("_first")).withColumn("_bucket", F.col("_bucket") - 1)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(at)
    with_next = cut.withColumn("_next", F.lead(at).over(inside))
    joined = _beside(with_next, firsts, [*keys, "_bucket"], "left")
    distance = F.coalesce(F.col("_next"), F.col("_first")) - F.col(at)
    return joined.select(*[F.col(c) for c in df.columns], F.when(distance < limit, distance).alias(name))
