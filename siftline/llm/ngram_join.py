"""Near duplicates by an n-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of 5-word shingles (hashed to 64 bits).  All documents order their shingles alike: those known to be
common last, by their counts, the others by hash.  In the l-prefix, the first ``n - ceil(t n) + l`` shingles, two sets
of Jaccard similarity t share at least l shingles.  Each document takes the l, from 1 to ``MAX_LEVEL``, at which its
estimated cost is least: postings to read plus candidates to verify, the latter bounded by postings over the matches asked.  A pair needs
as many shared prefix shingles as the smaller l of the two, and more the closer its sizes are, and is then verified on
the texts.

No group is expanded into all its pairs.  Documents with equal sets are one node.  Per shared shingle, nodes first
meet only a leader (the node that shares most); the verified links give components, and afterwards only nodes of
different components that share a shingle still meet, so no link between components is lost.

Counts of common shingles are sums over all documents; at most ``COMMON`` of the most frequent are broadcast to
set the order, which changes cost but never results.

Defined results: a null text is empty; a text without words has an empty set and links with nothing; fewer than five
words make one shingle; repeated rows are copies of each other; a null doc_id is its own component unless it links;
an empty table gives an empty result; further columns are ignored.
"""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from .common import broadcast_up_to, forget_kept, row_identity, stored, text_bytes
from .components import components

WIDTH, PERCENT = 5, 80
MAX_LEVEL = 4
#: How many posting reads one verification costs, for the choice of the prefix.
VERIFY_COST = 50.0
#: Common shingles whose counts set the order, and the hashes one task holds while it counts.
COMMON, COUNT_AT_ONCE = 200_000, 4_000_000
#: A common shingle's postings are salted into parts of about this many documents.
SALT_SHARE = 20_000
#: Ids of documents to verify are broadcast up to this many.
BROADCAST_IDS = 1_000_000


def required(n, percent=PERCENT):
    """Overlap that a set of n shingles needs at least with any similar set."""
    return -(-percent * n // 100)


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text", row_identity(documents).alias("row_id"))


def describe(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """Stored (doc_id, text_key, row_id, n, node, common): one row per document, and rows that only carry counted hashes.

    ``common`` holds (hash, count) of shingles that occur in two or more different sets of one task.
    """

    def read(batches):
        forget_kept()
        import numpy as np
        import pyarrow as pa

        seen, held, size = set(), [], 0

        def row_batch(docs, keys, places, sizes, nodes, common):
            numbers = [pa.array(c, pa.int64()) for c in (docs, keys, places, sizes, nodes)]
            return pa.RecordBatch.from_arrays([*numbers, pa.array(common, pa.binary())], ["doc_id", "text_key", "row_id", "n", "node", "common"])

        def counted():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            pairs = np.stack([values[often], counts[often].astype("u8")], axis=1)
            for k in range(0, len(pairs), 100_000):
                yield row_batch([None], [None], [None], [-1], [None], [pairs[k:k + 100_000].tobytes()])

        for batch in batches:
            sizes, nodes = [], []
            for texts in shingles.grouped(list(text_bytes(batch.column(2)))):
                for s in shingles.shingle_sets(texts, width):
                    node = shingles.set_id(s)
                    sizes.append(len(s))
                    nodes.append(node)
                    if node not in seen:
                        seen.add(node)
                        held.append(s)
                        size += len(s)
                if size > COUNT_AT_ONCE:
                    yield from counted()
                    seen, held, size = set(), [], 0
            yield row_batch(batch.column(0), batch.column(1), batch.column(3), sizes, nodes, [None] * len(sizes))
        if size:
            yield from counted()

    return stored(_rows(documents).mapInArrow(read, "doc_id long, text_key long, row_id long, n long, node long, common binary"), "sets")


def common_shingles(described: DataFrame, most: int = COMMON):
    """Sorted hashes and counts of at most ``most`` common shingles, the most frequent ones."""
    import numpy as np

    def unpack(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0).to_pylist():
                pairs = np.frombuffer(data, "u8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view("i8")), pa.array(pairs[:, 1].view("i8"))], ["token", "n"])

    counts = stored(described.filter(F.col("common").isNotNull()).select("common").mapInArrow(unpack, "token long, n long")
                    .groupBy("token").agg(F.sum("n").alias("n")).filter("n > 2"), "common")
    # the smallest count at which no more than ``most`` shingles are left
    tail, least = 0, None
    for row in sorted(counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().collect(), key=lambda r: -r["n"]):
        if tail + row["count"] > most:
            break
        tail, least = tail + row["count"], row["n"]
    if least is None:
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    found = counts.filter(F.col("n") >= least).toPandas()
    tokens = found["token"].to_numpy("i8").view("u8")
    order = np.argsort(tokens)
    return tokens[order], found["n"].to_numpy("i8")[order]


def prefix_of(s, common, percent=PERCENT, levels=MAX_LEVEL):
    """The longest prefix of a set: hashes in global order with their known counts (0 if not common)."""
    import numpy as np

    length = min(len(s), len(s) - required(len(s), percent) + min(levels, required(len(s), percent)))
    tokens, counts = common
    if not len(tokens):
        return s[:length], np.zeros(length, "i8")
    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
    hot = tokens[at] == s
    cold = s[~hot][:length]
    if len(cold) == length:
        return cold, np.zeros(length, "i8")
    rest, n = s[hot], counts[at[hot]]
    order = np.lexsort((rest, n))[:length - len(cold)]
    return np.concatenate([cold, rest[order]]), np.concatenate([np.zeros(len(cold), "i8"), n[order]])


def shared_postings(documents: DataFrame, common, width=WIDTH, percent=PERCENT) -> DataFrame:
    """Stored (token, node, n, pos, df): prefix shingles that stand in the prefixes of two or more nodes."""
    held = documents.sparkSession.sparkContext.broadcast(common)  # at most COMMON shingles

    def emit(batches):
        forget_kept()
        import numpy as np
        import pyarrow as pa

        seen = set()
        for batch in batches:
            parts = []
            for texts in shingles.grouped(list(text_bytes(batch.column(0)))):
                for s in shingles.shingle_sets(texts, width):
                    node = shingles.set_id(s)
                    if node in seen or not len(s):
                        continue
                    seen.add(node)
                    tokens, counts = prefix_of(s, held.value, percent)
                    # size, position and salt share one column: 28, 27 and 8 bits, more than a string can ask for
                    place = (np.int64(len(s)) << np.int64(35)) | (np.arange(len(tokens), dtype="i8") << 8)
                    salt = np.int64(node & 0x7FFFFFFF) % np.minimum(counts // SALT_SHARE + 1, 255)
                    parts.append((tokens.view("i8"), np.full(len(tokens), node, "i8"), place | salt))
                if len(seen) > 500_000:
                    seen = set()
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["token", "node", "place"])

    def meet(batches):
        import numpy as np
        import pyarrow as pa

        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        table = pa.Table.from_batches(batches)
        token, node, place = (table.column(k).to_numpy() for k in range(3))
        order = np.lexsort((node, token))
        token, node, place = token[order], node[order], place[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, place = token[new], node[new], place[new]
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        df = np.repeat(np.diff(np.append(begin, len(token))), np.diff(np.append(begin, len(token))))
        tokens, counts = held.value
        if len(tokens):
            at = np.minimum(np.searchsorted(tokens, token.view("u8")), len(tokens) - 1)
            hot = tokens[at] == token.view("u8")
            df = np.where(hot, np.maximum(df, counts[at]), df)
        keep = df > 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[keep]) for c in (token, node, place >> 35, (place >> 8) & 0x7FFFFFF, df.astype("i8"))], ["token", "node", "n", "pos", "df"])

    postings = documents.select("text").mapInArrow(emit, "token long, node long, place long")
    met = postings.repartition("token", F.col("place").bitwiseAND(F.lit(255)))
    return stored(met.mapInArrow(meet, "token long, node long, n long, pos long, df long"), "postings")


def choose_levels(postings: DataFrame, percent=PERCENT) -> DataFrame:
    """Adds ``level`` (of the posting), ``want`` (the l its node takes), ``shared`` (its node's postings) and ``rank``.

    The rank counts the node's shared shingles before this one: no others there can be in common with any other node.
    """
    need = F.ceil(F.col("n") * percent / 100).cast("long")
    leveled = postings.withColumn("level", F.greatest(F.lit(1), F.col("pos") - (F.col("n") - need) + 1)).withColumn("need", need)
    leveled = leveled.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("pos")) - 1)  # within one document
    reads = [F.sum(F.when(F.col("level") <= k, F.col("df") - 1).otherwise(0)) for k in range(1, MAX_LEVEL + 1)]
    costs = leveled.groupBy("node").agg(F.count("*").alias("shared"), F.first("need").alias("need"), F.first("n").alias("n"), *[r.alias(f"r{k}") for k, r in enumerate(reads, 1)])
    # against a set of its own size a node needs this many shared prefix shingles more than l
    more = F.ceil(2 * F.col("n") * percent / (100 + percent)) - F.col("need")
    options = F.array(*[
        F.struct(F.when(F.col("need") >= k, F.col(f"r{k}") * (1 + VERIFY_COST / (more + k))).otherwise(F.lit(float("inf"))).alias("cost"), F.lit(k).alias("want"))
        for k in range(1, MAX_LEVEL + 1)])
    chosen = costs.select("node", "shared", F.array_min(options)["want"].alias("want"))
    return stored(leveled.drop("need").join(chosen, "node").filter(F.col("level") <= F.col("want")), "leveled")


def _possible(a, b, percent=PERCENT):
    """Sizes and positions of one shared shingle still allow the similarity."""
    an, bn, ap, bp, ar, br = (F.col(f"{x}.{c}") for c in ("n", "pos", "rank") for x in (a, b))
    most = F.least(ar, br) + 1 + F.least(an - ap - 1, bn - bp - 1)
    return (most * (100 + percent) >= percent * (an + bn)) & (F.least(an, bn) * 100 >= F.greatest(an, bn) * percent)


def _asked(percent=PERCENT):
    """Shared prefix shingles that a pair of this l and these sizes needs.

    Shingles beyond the prefix that ends first add at most the larger of the two rests to the overlap, which
    must reach t / (1 + t) of both sizes together; so sets of like size must share more than l.
    """
    need = lambda side: F.ceil(F.col(f"{side}.n") * percent / 100)
    overlap = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent))
    return F.least("x.want", "y.want") + overlap - F.greatest(need("x"), need("y"))


def _matched(x: DataFrame, y: DataFrame, condition, asked, percent) -> DataFrame:
    """Pairs of nodes that share at least ``asked`` prefix shingles."""
    want = F.least("x.want", "y.want")
    left = lambda side: F.col(f"{side}.shared") - F.col(f"{side}.rank") - 1
    most = F.least("x.rank", "y.rank") + 1 + F.least(left("x"), left("y"))  # shared prefix shingles of any such pair
    on = (F.col("x.token") == F.col("y.token")) & condition & _possible("x", "y", percent) & (F.greatest("x.level", "y.level") <= want) & (most >= asked)
    joined = x.alias("x").join(y.alias("y"), on)
    pairs = joined.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), asked.alias("asked"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("hits"), F.first("asked").alias("asked")).filter("hits >= asked").select("a", "b")


def leader_pairs(postings: DataFrame, percent=PERCENT) -> DataFrame:
    """Candidates between the nodes of a shingle and its leader, the node with the most shared shingles."""
    leader = F.max_by(F.struct("node", "n", "pos", "rank", "shared", "level", "want"), F.struct("shared", "node"))
    # a stored side lets adaptive execution split the other at a very common shingle
    leaders = stored(postings.groupBy("token").agg(leader.alias("l")).select("token", "l.*"), "leaders")
    # not all of a pair's shingles have this leader, so no more than l are asked for here
    return _matched(postings, leaders, F.col("x.node") != F.col("y.node"), F.least("x.want", "y.want"), percent)


def crossing_pairs(postings: DataFrame, labels: DataFrame, percent=PERCENT) -> DataFrame:
    """Candidates between nodes of different components; shingles within one component drop out first."""
    named = postings.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = stored(named.groupBy("token").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low <> _high").select("token"), "mixed")
    open_postings = stored(named.join(mixed, "token"), "open-postings")
    return _matched(open_postings, open_postings, (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")), _asked(percent), percent)


def verified(documents: DataFrame, nodes: DataFrame, pairs: DataFrame, width=WIDTH, percent=PERCENT) -> DataFrame:
    """The pairs whose texts are similar, computed from the whole texts."""
    pairs = stored(pairs, "candidates")
    ids = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    asked = stored(nodes.join(ids, "node").select("node", F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")), "asked")
    texts = stored(_rows(documents).join(
        broadcast_up_to(asked, BROADCAST_IDS), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))
    ).select("node", "text").dropDuplicates(["node"]), "texts")

    def compare(batches):
        forget_kept()
        import numpy as np
        import pyarrow as pa

        last, leader = None, None
        for batch in batches:
            a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            others = [s for texts in shingles.grouped(list(text_bytes(batch.column(3)))) for s in shingles.shingle_sets(texts, width)]
            for k, (node, text, other) in enumerate(zip(a, text_bytes(batch.column(2)), others)):
                if node != last:
                    last, leader = node, next(shingles.shingle_sets([text], width))
                both = len(np.intersect1d(leader, other, assume_unique=True))
                if both and 100 * both >= percent * (len(leader) + len(other) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], ["a", "b"])

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    return both.select("a", "b", "a_text", "b_text").mapInArrow(compare, "a long, b long")


def grouped_rows(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Stored (doc_id, row_id, n, component, component_id): every row with its component, null for empty sets."""
    described = describe(documents, width)
    rows = described.filter("n >= 0").select("doc_id", "text_key", "row_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    # a set's representative is its smallest document; sets are one node however many copies they have
    nodes = stored(rows.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("r"), F.min("doc_id").alias("least"))
                   .select("node", "r.doc_id", "r.text_key", "least"), "nodes")
    postings = choose_levels(shared_postings(documents, common_shingles(described), width, percent), percent)
    first = stored(verified(documents, nodes, leader_pairs(postings, percent), width, percent), "links")
    rest = verified(documents, nodes, crossing_pairs(postings, components(first), percent), width, percent)
    labels = stored(components(first.unionAll(rest)), "labels")
    least = labels.join(nodes, "node").groupBy("component").agg(F.min("least").alias("first_doc"))
    linked = labels.join(least, "component").select("node", "component", "first_doc")
    named = nodes.select("node", "least").join(linked, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"), F.coalesce("first_doc", "least").alias("component_id"))
    return stored(rows.join(stored(named, "named"), "node", "left").select("doc_id", "row_id", "n", "component", "component_id"), "grouped")


def near_duplicates(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    rows = grouped_rows(documents, width, percent)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def without_near_duplicates(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, but of each component only the one with the smallest doc_id.

    Of repeated rows one stays; texts without words link with nothing and stay.
    """
    rows = grouped_rows(documents, width, percent).filter(F.col("component").isNotNull())
    keep = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_id"))["row_id"]
    keepers = stored(rows.groupBy("component").agg(keep.alias("_keep")), "keepers")
    dropped = rows.join(keepers, "component").filter(F.col("row_id") != F.col("_keep")).select(F.col("row_id").alias("_row"), F.col("doc_id").alias("_doc"))
    dropped = broadcast_up_to(stored(dropped, "dropped"), BROADCAST_IDS)
    named = documents.withColumn("_row_id", row_identity(documents))
    return named.join(dropped, (F.col("_row_id") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left_anti").select(*documents.columns)
