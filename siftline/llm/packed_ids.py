"""Token ids in fixed-width bit packing.

A shard file holds, little-endian: packed blocks of ``BLOCK`` ids at the minimum bits of the vocabulary, the byte
offset of every block, the documents' ids (int64), a null mark per document and the documents' token counts (int64),
and a fixed footer with the section places.  Any id range is read by seeking to its blocks and unpacking them with
numpy.  Shards follow ascending doc_id; within one doc_id the text's hash decides, so that repeated rows spread.

A shard is written under a name of its own by each task attempt and counts only once its manifest row is committed,
so a lost or repeated task leaves nothing half written in the result.

Words between ASCII white space are encoded once per worker and remembered up to a bound: the tokenizer's
normaliser and splitter never join across white space, so the ids equal those of the whole text.

Defined results: a null text is empty and gets only the end id; a null doc_id comes first; repeated rows stay, each
encoded; an empty table gives an empty result; further columns are ignored.
"""
import struct
import uuid
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_run_folder
from .common import file_system, kept_by_worker, stored, text_bytes

MAGIC = b"SLPACK01"
FOOTER = struct.Struct("<8sIIQQQQQQ")
#: Ids per block; a multiple of 8, so every block ends on a whole byte.
BLOCK = 1 << 16
END_ID = 2
#: Words of each of two generations remembered by one Python worker, and the longest that is.
REMEMBER_WORDS, REMEMBER_BYTES = 500_000, 64
#: ASCII punctuation that the tokenizer splits from the letter or digit before it.
TAIL = b",.;:!?%#*$&)"
ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
#: Longer texts are split at white space into slices of this many bytes.
SLICE = 1 << 20


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids, bits: int) -> bytes:
    """Pack unsigned ids at a fixed width, lowest bit first."""
    import numpy as np

    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(((ids[:, None] >> np.arange(bits, dtype="u4")) & 1).astype("u1"), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int):
    """The first ``count`` ids of packed data as unsigned 32-bit integers."""
    import numpy as np

    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    spread = np.unpackbits(np.frombuffer(data, "u1"), bitorder="little", count=count * bits).reshape(count, bits)
    return (spread.astype("<u4") << np.arange(bits, dtype="u4")).sum(axis=1, dtype="<u4")


def _slices(data: bytes):
    start = 0
    while len(data) - start > SLICE:
        end = start + SLICE
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[start:end]
        start = end
    yield data[start:]


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, by remembered words.

    Words live in two generations: a full young one becomes the old one, and words met again are taken over.
    """

    def __init__(self, path):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.old = {}, {}

    @classmethod
    def of(cls, path):
        """One encoder per worker process and vocabulary file."""
        return kept_by_worker(("encoder", path), lambda: cls(path))

    @staticmethod
    def _parts(word):
        """A word and the punctuation after it are separate pieces for the tokenizer, so each is learned once."""
        stem = word.rstrip(TAIL)
        return (stem, word[len(stem):]) if stem and len(stem) < len(word) and stem[-1] in ALNUM else (word,)

    def _learn(self, words):
        import array

        parts = {w: self._parts(w) for w in words}
        new = list({p for ps in parts.values() for p in ps if p not in self.words and p not in self.old})
        found = {}
        for word, got in zip(new, self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)):
            found[word] = array.array("I", got.ids).tobytes()
        for ps in parts.values():
            for p in ps:
                if p not in self.words:
                    self.words[p] = found[p] if p in found else self.old[p]
        for word, ps in parts.items():
            if len(ps) == 2:
                self.words[word] = self.words[ps[0]] + self.words[ps[1]]

    def encode(self, data: bytes) -> bytes:
        out = []
        for piece in _slices(data):
            # the tokenizer lower-cases; doing it first for A-Z changes nothing unless a combining mark or a special token follows
            plain = b"\xcc" not in piece and b"\xcd" not in piece and b"<|" not in piece
            words = (piece.lower() if plain else piece).split()
            new = {w for w in words if w not in self.words}
            if new:
                if len(self.words) + len(new) > REMEMBER_WORDS:
                    self.words, self.old = {}, self.words
                    new = set(words)
                back = {w for w in new if w in self.old}
                self.words.update((w, self.old[w]) for w in back)
                self._learn(new - back)
            out.append(b"".join([self.words[w] for w in words]))
            for w in new:
                if len(w) > REMEMBER_BYTES:
                    self.words.pop(w, None)
        return b"".join(out)


class ShardWriter:
    """Writes packed blocks as they fill; keeps 17 bytes per document until the end."""

    def __init__(self, stream, vocabulary: int):
        self.stream, self.vocabulary, self.bits = stream, vocabulary, bits_for(vocabulary)
        self.rest, self.offsets, self.place, self.total = b"", [], 0, 0
        self.docs, self.nulls, self.counts = [], [], []

    def _write(self, data):
        self.stream.write(data)
        self.place += len(data)

    def add(self, doc_id, ids: bytes):
        import numpy as np

        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids) // 4)
        self.total += len(ids) // 4
        self.rest += ids
        whole = len(self.rest) // (BLOCK * 4)
        for k in range(whole):
            self.offsets.append(self.place)
            self._write(pack(np.frombuffer(self.rest, "<u4", BLOCK, k * BLOCK * 4), self.bits))
        if whole:
            self.rest = self.rest[whole * BLOCK * 4:]

    def close(self):
        import numpy as np

        if self.rest:
            self.offsets.append(self.place)
            self._write(pack(np.frombuffer(self.rest, "<u4"), self.bits))
        sections = []
        for values, kind in ((self.offsets, "<i8"), (self.docs, "<i8"), (self.nulls, "u1"), (self.counts, "<i8")):
            sections.append(self.place)
            self._write(np.array(values, kind).tobytes())
        self._write(FOOTER.pack(MAGIC, self.bits, BLOCK, self.total, len(self.docs), *sections))


class ShardReader:
    """Random access to a shard: ``documents`` lists them, ``ids(start, count)`` reads only the blocks it needs."""

    def __init__(self, stream, size: int):
        self.stream, self.size = stream, size
        stream.seek(size - FOOTER.size)
        magic, self.bits, self.block, self.total, self.n_docs, *self.sections = FOOTER.unpack(stream.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a packed id shard")
        self.offsets = self._array(self.sections[0], "<i8", -(-self.total // self.block))

    def _array(self, place, kind, count):
        import numpy as np

        self.stream.seek(place)
        return np.frombuffer(self.stream.read(np.dtype(kind).itemsize * count), kind)

    def documents(self):
        """(doc_id or None, token count) of each document, in order."""
        docs, nulls, counts = (self._array(p, k, self.n_docs) for p, k in zip(self.sections[1:], ("<i8", "u1", "<i8")))
        return [None if n else int(d) for d, n in zip(docs, nulls)], counts

    def ids(self, start: int, count: int):
        import numpy as np

        parts, end = [], min(start + count, self.total)
        while start < end:
            k, skip = divmod(start, self.block)
            held = min(self.block, self.total - k * self.block)
            self.stream.seek(int(self.offsets[k]))
            got = unpack(self.stream.read(-(-held * self.bits // 8)), self.bits, held)[skip:skip + end - start]
            parts.append(got)
            start += len(got)
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def write_shards(documents: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Encode and write all documents; returns the stored manifest (shard, path, bytes, n_docs, n_ids)."""
    folder = new_run_folder(documents.sparkSession, "packed-ids")

    def write(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa
        from pyspark import TaskContext

        writer, stream, end = None, None, struct.pack("<I", end_id)
        for batch in batches:
            if writer is None and batch.num_rows:
                shard = TaskContext.get().partitionId()
                system, root = file_system(folder)
                system.create_dir(root, recursive=True)
                name = f"shard-{shard:06d}-{uuid.uuid4().hex}.bin"
                stream = system.open_output_stream(f"{root}/{name}")
                encoder = Encoder.of(tokenizer_path)
                writer = ShardWriter(stream, encoder.tokenizer.get_vocab_size())
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                writer.add(doc_id, encoder.encode(text) + end)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int64()), "path": [f"{folder}/{name}"], "bytes": pa.array([writer.place], pa.int64()),
                "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([writer.total], pa.int64())})

    rows = documents.select(F.col("doc_id").cast("long"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(spread.mapInArrow(write, "shard long, path string, bytes long, n_docs long, n_ids long"), "packed-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Read every shard back: doc_id, start (ids before it over all shards), n_tokens, ids_crc32."""

    def read(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for path, size, before in zip(*(c.to_pylist() for c in batch.columns)):
                system, place = file_system(path)
                with system.open_input_file(place) as stream:
                    shard = ShardReader(stream, size)
                    docs, counts = shard.documents()
                    ends = np.cumsum(counts)
                    sums, held, low = [], np.zeros(0, "<u4"), 0
                    for count, end in zip(counts.tolist(), ends.tolist()):
                        if end > low + len(held):
                            low = end - count
                            held = shard.ids(low, max(count, 8 * BLOCK))
                        sums.append(zlib.crc32(held[end - count - low:end - low].tobytes()))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(docs, pa.int64()), "start": pa.array(before + ends - counts, pa.int64()),
                        "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})

    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    placed = manifest.select("path", "bytes", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("before"))
    return placed.repartition("path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed_tokens(documents: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write all documents as packed shards and read them back."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return read_shards(write_shards(documents, tokenizer_path))
