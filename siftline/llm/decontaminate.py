"""Benchmark passages in documents by SimHash of item-sized windows and a multi-index over Hamming blocks.

Words are runs of letters and digits of the lower-cased text; an item of n words is compared with windows of n words.
A window without a single shingle of the benchmark has similarity 0, so windows are laid only where a shared shingle
puts an item over a document; this loses nothing, and does not yet say which item a window is compared with.  That the
multi-index does: every window and item gets a 256-bit SimHash of its distinct 5-word shingles, each with the root of its
count times its weight.  Fingerprints are cut into ``BLOCKS`` blocks of 16 bits; two within ``RADIUS`` < 4 * BLOCKS bits
differ by at most three bits in some block, so items are filed under each block value and all values up to two bits
away, windows look up their values and those one bit away, and all pairs of one size within the radius meet.
The exact weighted Jaccard similarity of the shingles then decides.

A shingle weighs ln(1 + items / items that hold it), so that wording many items share counts less; shingles outside the
benchmark weigh as much as those of one item.  With roots the cosine is at least 8/9 at similarity 0.8 however uneven the
weights are.  Fingerprints of such pairs then differ by 39 bits on average with a deviation of 5.7 (as for a normal sum, so
for more than a few shingles), and the radius of 63 is four deviations away: about one pair in 50 000 at exactly 0.8 is lost.
Unrelated fingerprints of one size agree that far in some block for one pair in six; sizes are part of the key, so with items of
20 to 150 words a window meets at most one item in 500 (tests), and the distance drops all but chance ones there.

Only DataFrame functions run here.  Copies of a text are scanned for hits where they lie, then share one text key, and
copies of a window share one content key, so that hot texts and passages are settled once.

Defined results: a null or wordless text, or item, and an item without an id take no part; items below five words are one shingle and match whole;
repeated rows appear once per row; a document shorter than an item is compared whole; an empty table on either side
gives an empty result; further columns are ignored.
"""
import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_up_to, stored

WIDTH, THRESHOLD = 5, 0.8
#: A fingerprint has ``HALVES`` longs and ``BLOCKS`` blocks.
HALVES, BLOCKS, BLOCK_BITS, RADIUS = 4, 16, 16, 63
#: Bits of a lane in which the weights of one fingerprint bit add up.
LANE = 21
#: Bits by which items are filed and windows look up beside their own block values: together RADIUS // BLOCKS.
FILED_BITS, ASKED_BITS = 2, 1
#: Benchmark shingles, block keys and texts with hits are broadcast up to this many rows each.
BROADCAST_SHINGLES, BROADCAST_KEYS = 500_000, 200_000
TOKEN = r"[\p{L}\p{N}]+"


def _word_hashes(text):
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingles(column: str, width: int):
    """Hashes of all runs of ``width`` words of a column of word hashes."""
    h = F.col(column)
    runs = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
    return F.when(F.size(h) >= width, runs).otherwise(F.array().cast("array<bigint>"))


def _text_key():
    return F.xxhash64("text", F.length("text"))


def benchmark_index(benchmark: DataFrame) -> DataFrame:
    """Stored (item_id, n_words, width, offset, shingle, weight): the shingles of every item, in place."""
    items = benchmark.select("item_id", _word_hashes(F.col("text")).alias("h")).filter(F.col("item_id").isNotNull() & (F.size("h") > 0))
    per_width = [
        items.filter(F.size("h") >= WIDTH if w == WIDTH else F.size("h") == w)
        .select("item_id", F.size("h").alias("n_words"), F.lit(w).alias("width"), F.posexplode(_shingles("h", w)).alias("offset", "shingle"))
        for w in range(1, WIDTH + 1)]
    placed = stored(functools.reduce(DataFrame.unionAll, per_width), "benchmark")
    total = placed.select(F.countDistinct("item_id")).first()[0]
    weights = placed.groupBy("shingle").agg(F.log1p(F.lit(float(total)) / F.countDistinct("item_id")).alias("weight"))
    return stored(placed.join(weights, "shingle").withColumn("rare", F.lit(float(total))), "benchmark-weights")


def _fingerprints(shingles: DataFrame, *key: str) -> DataFrame:
    """256-bit SimHash of distinct rows (key, shingle, n, weight), as longs f0 to f3.

    A bit is set where the shingles with a one there hold more than half of all weight.  Weights become shares of 2**LANE, so
    that one sum of longs serves three bits, each in a lane of its own: 22 sums per long in place of 64.
    """
    weight = F.sqrt(F.col("n") * F.col("weight"))
    total = shingles.groupBy(*key).agg(F.sum(weight).alias("total"))
    share = F.floor(weight / F.col("total") * ((1 << LANE) - 1))
    longs = F.array(*[F.col("shingle") if k == 0 else F.xxhash64("shingle", F.lit(k)) for k in range(HALVES)])
    rows = shingles.join(total, list(key)).select(*key, share.alias("share"), F.posexplode(longs).alias("part", "hash"))

    def in_lanes(bit):
        three = F.shiftrightunsigned("hash", bit)
        lanes = [F.shiftleft(three.bitwiseAND(F.lit(1 << i)), (LANE - 1) * i) for i in range(min(3, 64 - bit))]
        return functools.reduce(lambda a, b: a.bitwiseOR(b), lanes)

    sums = rows.groupBy(*key, "part").agg(F.sum("share").alias("all"), *[F.sum(in_lanes(bit) * F.col("share")).alias(f"s{bit // 3}") for bit in range(0, 64, 3)])

    def bit_of(bit):
        ones = F.shiftrightunsigned(f"s{bit // 3}", LANE * (bit % 3)).bitwiseAND(F.lit((1 << LANE) - 1))
        return F.when(2 * ones > F.col("all"), F.lit((1 << bit) - (1 << 64) * (bit == 63))).otherwise(F.lit(0)).cast("long")

    words = sums.select(*key, "part", functools.reduce(lambda a, b: a.bitwiseOR(b), map(bit_of, range(64))).alias("word"))
    return words.groupBy(*key).agg(*[F.max(F.when(F.col("part") == k, F.col("word"))).alias(f"f{k}") for k in range(HALVES)])


def _blocks(bits: int):
    """Rows (block, value) of a fingerprint's blocks and of all values up to ``bits`` bits away from them."""
    each, mask = BLOCKS // HALVES, (1 << BLOCK_BITS) - 1
    values = [F.shiftrightunsigned(f"f{k // each}", BLOCK_BITS * (k % each)).bitwiseAND(F.lit(mask)).cast("int") for k in range(BLOCKS)]
    flips = F.array(*[F.lit(x) for x in range(1 << BLOCK_BITS) if x.bit_count() <= bits])
    own = F.array(*[F.struct(F.lit(k).alias("block"), value.alias("value")) for k, value in enumerate(values)])
    return F.inline(F.flatten(F.transform(own, lambda b: F.transform(flips, lambda x: F.struct(b["block"].alias("block"), b["value"].bitwiseXOR(x).alias("value"))))))


def candidates(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (content, item_id) of one size whose fingerprints are within RADIUS bits.

    Both sides hold (key, n_words, shingle, n, weight) rows; keys are ``content`` and ``item_id``.
    """
    mine = stored(_fingerprints(items, "item_id", "n_words"), "item-fingerprints")
    mine = mine.select("item_id", "n_words", *[F.col(f"f{k}").alias(f"i{k}") for k in range(HALVES)], _blocks(FILED_BITS))
    filed = stored(mine, "item-blocks")
    asked = stored(_fingerprints(windows, "content", "n_words"), "window-fingerprints")
    asked = asked.select("content", "n_words", *[f"f{k}" for k in range(HALVES)], _blocks(ASKED_BITS))
    distance = functools.reduce(lambda a, b: a + b, [F.bit_count(F.col(f"f{k}").bitwiseXOR(F.col(f"i{k}"))) for k in range(HALVES)])
    met = asked.join(broadcast_up_to(filed, BROADCAST_KEYS), ["n_words", "block", "value"])
    return met.filter(distance <= RADIUS).select("content", "item_id").distinct()


def _counted(shingles: DataFrame, key: str) -> DataFrame:
    return shingles.groupBy(key, "n_words", "shingle").agg(F.count("*").alias("n"), F.first("weight").alias("weight"))


def windows_with_hits(documents: DataFrame, index: DataFrame) -> DataFrame:
    """Stored (text_key, start, n_words, width): places where a shared shingle lays an item over a text."""
    widths = sorted(r[0] for r in index.select("width").distinct().collect())  # at most WIDTH numbers
    texts = documents.filter(F.col("text").isNotNull()).select(_text_key().alias("text_key"), _word_hashes(F.col("text")).alias("h"))
    wanted = broadcast_up_to(index.select("width", F.col("shingle"), "offset", "n_words").distinct(), BROADCAST_SHINGLES)
    found = []
    for width in widths:
        placed = texts.select("text_key", F.size("h").alias("size"), F.posexplode(_shingles("h", width)).alias("pos", "shingle"))
        hits = placed.join(wanted.filter(F.col("width") == width), "shingle")
        start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("offset"), F.col("size") - F.col("n_words")))
        found.append(hits.select("text_key", start.alias("start"), "n_words", "width"))
    if not found:
        found = [texts.select("text_key", F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit(0).alias("width")).limit(0)]
    return stored(functools.reduce(DataFrame.unionAll, found).distinct(), "windows")


def _leaked_texts(documents: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """Stored (text_key, item_id, similarity) of the texts that hold an item."""
    index = benchmark_index(benchmark)
    windows = windows_with_hits(documents, index)
    keys = stored(windows.select(F.col("text_key").alias("_key")).distinct(), "hit-texts")
    texts = documents.filter(F.col("text").isNotNull()).withColumn("text_key", _text_key())
    texts = texts.join(broadcast_up_to(keys, BROADCAST_KEYS), F.col("text_key") == F.col("_key")).select("text_key", "text").dropDuplicates(["text_key"])
    hashed = texts.select("text_key", _word_hashes(F.col("text")).alias("h"))
    cut = windows.join(hashed, "text_key").select("text_key", "width", "n_words", F.slice("h", F.col("start") + 1, F.col("n_words")).alias("w"))
    contents = [cut.filter(F.col("width") == w).select("text_key", "n_words", _shingles("w", w).alias("s")) for w in range(1, WIDTH + 1)]
    cut = functools.reduce(DataFrame.unionAll, contents).filter(F.size("s") > 0)
    cut = stored(cut.select("text_key", F.xxhash64("s", "n_words").alias("content"), "n_words", "s").distinct(), "window-contents")
    # each different window once, with its shingles weighted
    weights = index.select("shingle", "weight").distinct()
    rare = F.log1p(F.lit(float((index.select("rare").first() or [0])[0])))
    shingles = cut.groupBy("content", "n_words").agg(F.first("s").alias("s")).select("content", "n_words", F.explode("s").alias("shingle"))
    shingles = shingles.groupBy("content", "n_words", "shingle").agg(F.count("*").alias("n"))
    shingles = stored(shingles.join(weights, "shingle", "left").withColumn("weight", F.coalesce("weight", rare)), "window-shingles")
    items = stored(_counted(index, "item_id"), "item-shingles")
    near = stored(candidates(shingles, items), "candidates")
    # exact weighted Jaccard: shared weight over the weight of either
    weight = lambda df, key, name: df.groupBy(key).agg(F.sum(F.col("n") * F.col("weight")).alias(name))
    shared = near.join(shingles, "content").join(items.select("item_id", "shingle", F.col("n").alias("m")), ["item_id", "shingle"])
    shared = shared.groupBy("content", "item_id").agg(F.sum(F.least("n", "m") * F.col("weight")).alias("both"))
    scored = shared.join(weight(shingles, "content", "w"), "content").join(weight(items, "item_id", "v"), "item_id")
    similarity = F.round(F.col("both") / (F.col("w") + F.col("v") - F.col("both")), 6)
    accepted = scored.select("content", "item_id", similarity.alias("similarity")).filter(F.col("similarity") >= threshold)
    best = cut.select("text_key", "content").join(accepted, "content").groupBy("text_key", "item_id").agg(F.max("similarity").alias("similarity"))
    return stored(best, "leaked-texts")


def leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and benchmark item it holds: doc_id, item_id, similarity (of its best window)."""
    best = _leaked_texts(documents, benchmark, threshold)
    held = documents.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), _text_key().alias("text_key"))
    return held.join(broadcast_up_to(best, BROADCAST_KEYS), "text_key").select("doc_id", "item_id", "similarity")


def without_leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text holds no benchmark item, with all their columns; null and repeated ids take no other row along."""
    found = stored(_leaked_texts(documents, benchmark, threshold).select(F.col("text_key").alias("_leak")).distinct(), "leaked-keys")
    return documents.join(broadcast_up_to(found, BROADCAST_KEYS), F.col("text").isNotNull() & (_text_key() == F.col("_leak")), "left_anti")
