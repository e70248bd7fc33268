"""Exact duplicates through cuckoo-filter indexes of live digests.

Every text becomes a SHA-256 digest inside its task.  Digests go through a cuckoo index twice: once per input
partition, which folds a hot text to one summary row per task, and once per digest partition, which merges the
summaries.  The index is a cuckoo filter of 15-bit fingerprints whose buckets also keep the full digest and its
record, so a filter hit is always verified against bucketed content, entries can be deleted, and a full filter is
rebuilt at twice the size from its stored keys.

Defined results: a null text equals the empty text; a null doc_id is smaller than any other; of repeated rows with
the same doc_id and text exactly one is kept; an empty table gives an empty result; further columns are ignored.
"""
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, stored, text_bytes

SLOTS = 4
MAX_KICKS = 256
#: Live digests one task holds before it hands its summaries on and starts a new index.
MAX_LIVE = 250_000


class CuckooIndex:
    """Cuckoo filter over buckets that hold (digest, record); supports insert, find, delete and resizing."""

    def __init__(self, buckets: int = 1024):
        self._reset(buckets)

    def _reset(self, buckets):
        self.mask = buckets - 1
        self.marks = [0] * (buckets * SLOTS)
        self.entries = [None] * (buckets * SLOTS)
        self.live = 0

    @staticmethod
    def _mark(digest):
        return (digest[8] << 8 | digest[9]) | 1

    def _first(self, digest):
        return int.from_bytes(digest[:8], "little") & self.mask

    def _other(self, bucket, mark):
        return bucket ^ (mark * 0x5BD1E995 & self.mask)

    def _slot(self, digest):
        mark = self._mark(digest)
        bucket = self._first(digest)
        for b in (bucket, self._other(bucket, mark)):
            for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.marks[slot] == mark and self.entries[slot][0] == digest:
                    return slot
        return -1

    def find(self, digest):
        """The record of a live digest, verified against the stored key; else None."""
        slot = self._slot(digest)
        return None if slot < 0 else self.entries[slot][1]

    def delete(self, digest) -> bool:
        slot = self._slot(digest)
        if slot < 0:
            return False
        self.marks[slot], self.entries[slot] = 0, None
        self.live -= 1
        return True

    def insert(self, digest, record):
        """Add a digest that is not live."""
        entry, mark = (digest, record), self._mark(digest)
        bucket = self._first(digest)
        self.live += 1
        for kick in range(MAX_KICKS):
            for b in (bucket, self._other(bucket, mark)):
                for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                    if not self.marks[slot]:
                        self.marks[slot], self.entries[slot] = mark, entry
                        return
            slot = bucket * SLOTS + kick % SLOTS
            self.marks[slot], mark = mark, self.marks[slot]
            self.entries[slot], entry = entry, self.entries[slot]
            bucket = self._other(bucket, mark)
        kept = [e for e in self.entries if e is not None] + [entry]
        self._reset((self.mask + 1) * 2)
        for e in kept:
            self.insert(*e)

    def items(self):
        return (e for e in self.entries if e is not None)

    def __len__(self):
        return self.live


def _digests(batches):
    import pyarrow as pa

    for batch in batches:
        digests = [hashlib.sha256(t.translate(LOWER_ASCII)).digest() for t in text_bytes(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary())], ["row_id", "doc_id", "digest"])


def _later(a, b):
    """The larger of two (doc_id, row) holders; a null doc_id is the smallest."""
    return max(a, b, key=lambda h: (h[0] is not None, h[0] or 0, h[1]))


def _merge(batches):
    """Fold (digest, holder, rows) through one index; used on rows and again on summaries."""
    import pyarrow as pa

    def summaries(index):
        entries = list(index.items())
        for start in range(0, len(entries), 10_000):
            part = entries[start:start + 10_000]
            yield pa.RecordBatch.from_arrays([
                pa.array([d for d, _ in part], pa.binary()), pa.array([r[0][0] for _, r in part], pa.int64()),
                pa.array([r[0][1] for _, r in part], pa.int64()), pa.array([r[1] for _, r in part], pa.int64()),
            ], ["digest", "keep_id", "keep_row", "group_size"])

    index = CuckooIndex()
    for batch in batches:
        for digest, doc, row, rows in zip(*(c.to_pylist() for c in batch.columns)):
            record, holder = index.find(digest), (doc, row)
            if record is None:
                index.insert(digest, (holder, rows))
            else:
                # the larger holder takes over: the old live entry goes, the new one comes
                index.delete(digest)
                index.insert(digest, (_later(record[0], holder), record[1] + rows))
        if len(index) > MAX_LIVE:
            yield from summaries(index)
            index = CuckooIndex()
    yield from summaries(index)


def exact_groups(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the lower-cased text)."""
    rows = documents.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), "text")
    digests = stored(rows.mapInArrow(_digests, "row_id long, doc_id long, digest binary"), "digests")
    summary = "digest binary, keep_id long, keep_row long, group_size long"
    local = digests.select("digest", "doc_id", "row_id", F.lit(1).cast("long").alias("n")).mapInArrow(_merge, summary)
    # a digest has at most a few summaries per task; groupBy settles those an index handed on early
    merged = local.repartition("digest").mapInArrow(_merge, summary)
    groups = merged.groupBy("digest").agg(
        F.max(F.struct(F.col("keep_id").isNotNull().alias("known"), "keep_id", "keep_row")).alias("h"), F.sum("group_size").alias("group_size")
    ).select("digest", "h.keep_id", "h.keep_row", "group_size")
    # copies of one text may be a third of all rows: a stored side lets adaptive execution split the other
    return digests.join(stored(groups, "groups"), "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
