"""Mixing sources to target weights by hash-threshold histograms.

Each source's target is its weight's share of all words, stopped at ``max_repeats`` times the source's own size;
what is cut off is shared again by weight until no source is above its stop.  A source is taken whole ``floor`` of
target / size times; the rest of its target is met by every document whose hash lies under a threshold.  Thresholds
come from nested histograms: words summed by source and hash bucket, then only the one bucket in which the budget
ends is refined, until it holds a single hash.  Rows are never sorted, so reruns and other partitionings agree.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a document with size 0
takes 0; repeated rows share their hash and are taken together; an empty table gives an empty result.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import broadcast_up_to, ranked, stored

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, LEVEL_BITS = 60, 12
#: Sources are broadcast to their documents up to this many.
BROADCAST_SOURCES = 100_000


def document_hash(doc_id):
    """60 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats=MAX_REPEATS) -> DataFrame:
    """(source, source_size, target, repeats, remainder); the driver sees two sums per round, never the sources."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = ranked(totals, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    sources = stored(sources.withColumn("weight", weight).withColumn("stop", F.col("source_size") * max_repeats), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, settled = 0.0, None
    while settled != level:
        settled = level
        stopped = F.col("weight") * F.lit(level) > F.col("stop")
        cut, free = sources.agg(F.sum(F.when(stopped, F.col("stop"))), F.sum(F.when(~stopped, F.col("weight")))).first()
        level = float(total - (cut or 0)) / free if free else level
    target = F.least(F.col("weight") * F.lit(level), F.col("stop").cast("double"))
    repeats = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return sources.select("source", "source_size", target.alias("target"), repeats.alias("repeats")).withColumn(
        "remainder", F.col("target") - F.col("repeats") * F.col("source_size")
    )


def _thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``below``: documents of the source with a smaller hash meet the remainder as nearly as whole documents can."""
    # state: hashes under ``start`` are in and hold ``before`` words; ``low`` and ``high`` bound the open bucket
    state = targets.withColumn("before", F.lit(0).cast("long")).withColumn("low", F.lit(0).cast("long")).withColumn(
        "high", F.lit(1 << HASH_BITS).cast("long")).withColumn("below", F.when(F.col("remainder") <= 0, F.lit(0)).cast("long"))
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        state = stored(state, "thresholds")
        if state.filter(F.col("below").isNull()).isEmpty():
            break
        shift = HASH_BITS - LEVEL_BITS * level
        opened = broadcast_up_to(state.filter(F.col("below").isNull()).select(F.col("source").alias("_source"), "low", "high"), BROADCAST_SOURCES)
        inside = sizes.join(opened, F.col("source").eqNullSafe(F.col("_source")) & (F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("high")))
        buckets = inside.groupBy("_source", F.shiftright("hash", shift).alias("_h")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("first"), F.max("hash").alias("last"))
        running = Window.partitionBy("_source").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
        upto = buckets.withColumn("_sum", F.coalesce(F.sum("words").over(running), F.lit(0)))
        joined = state.join(upto, F.col("source").eqNullSafe(F.col("_source")) & F.col("below").isNull(), "left").withColumn("_start", F.col("before") + F.col("_sum"))
        # the bucket in which the budget ends; none if the source ends first
        ends = (F.col("_start") < F.col("remainder")) & (F.col("_start") + F.col("words") > F.col("remainder"))
        cut = F.struct("_start", "words", "first", "last")
        found = joined.groupBy("source").agg(
            F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("repeats").alias("repeats"),
            F.first("remainder").alias("remainder"), F.first("before").alias("_before"), F.first("low").alias("_low"),
            F.first("high").alias("_high"), F.first("below").alias("_below"), F.first(F.when(ends, cut), ignorenulls=True).alias("c"),
            F.max(F.when(F.col("_start") + F.col("words") <= F.col("remainder"), F.col("last"))).alias("whole"))
        single = F.col("c.first") == F.col("c.last")
        nearer = 2 * F.col("c._start") + F.col("c.words") <= 2 * F.col("remainder")
        below = (
            F.when(F.col("_below").isNotNull(), F.col("_below"))
            .when(F.col("c").isNull(), F.coalesce(F.col("whole") + 1, F.col("_low")))
            .when(single, F.when(nearer, F.col("c.first") + 1).otherwise(F.col("c.first")))
        )
        state = found.select(
            "source", "source_size", "target", "repeats", "remainder", F.coalesce("c._start", "_before").alias("before"),
            F.coalesce("c.first", "_low").alias("low"), F.coalesce(F.col("c.last") + 1, F.col("_high")).alias("high"), below.alias("below"))
    return stored(state.select("source", "source_size", "target", "repeats", "below"), "thresholds")


def _limits(documents: DataFrame, weights, max_repeats):
    """Stored sizes of the documents, and the passes and hash threshold of every source."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    sizes = stored(documents.select("doc_id", "source", size.alias("size"), document_hash(F.col("doc_id")).alias("hash")), "sizes")
    limits = _thresholds(sizes, source_targets(sizes, weights, max_repeats)).withColumnRenamed("source", "_source")
    return sizes, broadcast_up_to(limits, BROADCAST_SOURCES)


def mix(documents: DataFrame, weights=WEIGHTS, max_repeats=MAX_REPEATS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, repeats (whole passes over the document)."""
    sizes, limits = _limits(documents, weights, max_repeats)
    joined = sizes.join(limits, F.col("source").eqNullSafe(F.col("_source")))
    passes = F.col("repeats") + (F.col("hash") < F.col("below")).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * passes).alias("taken"), passes.alias("repeats"))


def mixed(documents: DataFrame, weights=WEIGHTS, max_repeats=MAX_REPEATS) -> DataFrame:
    """The documents as the mix takes them, each row as often as it is taken; texts move nowhere."""
    _, limits = _limits(documents, weights, max_repeats)
    limits = limits.select("_source", F.col("repeats").alias("_repeats"), F.col("below").alias("_below"))
    joined = documents.join(limits, F.col("source").eqNullSafe(F.col("_source")))
    passes = F.col("_repeats") + (document_hash(F.col("doc_id")) < F.col("_below")).cast("long")
    taken = joined.withColumn("_passes", passes).filter("_passes > 0")
    return taken.withColumn("_pass", F.explode(F.sequence(F.lit(1).cast("long"), "_passes"))).select(*documents.columns)
