"""Fill-in-the-middle transformation: two cuts per document, found on a wavelet matrix over character classes.

Every code point gets one of eight classes: its kind (blank, line break, word character, mark) and whether a run of
white space or of other characters ends with it.  The classes of a slice of documents are laid end to end and stored as
a wavelet matrix of three bit vectors with sampled counts.  ``rank(class, i)`` takes three steps; the number of units that
end before a place is a sum of such ranks, and the place of the k-th end is found by bisection on that sum, for
all documents of a slice at once.  A unit is a token (white space and the run of other characters behind it) or a
line; white space behind the last token, or text behind the last line break, is one more unit.

A text meets the worker only to be cut: the worker returns three numbers, and the output is put together from them by
Spark's own string functions.  A slice holds ``SLICE`` bytes of text or one longer text.

Defined results: a null text is empty; an empty text and one that holds a sentinel stay plain; a null doc_id is hashed
as an empty string; rows with one doc_id share their cuts' hashes, and repeated rows give repeated rows; equal cuts leave an empty
middle; an empty table gives an empty result; further columns are kept by ``transform`` unless they have a name it adds,
which is then replaced.
"""
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 documents as many stay plain, and of 100 others as many begin with the suffix.
PLAIN, SUFFIX_FIRST = 50, 80
#: Bytes of text whose wavelet matrix is held at once; a longer text is a slice of its own.
SLICE = 4 << 20
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")

BLANK, BREAK, WORD, MARK = range(4)
#: The kind of a code point by the first byte of its UTF-8 form.
KIND = np.full(256, MARK, np.uint8)
KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = BLANK
KIND[0x0A] = BREAK
KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B), *range(0x80, 0x100)]] = WORD
#: Classes (twice the kind, plus one at the end of a run) whose code points end a unit.
UNITS = {"token": (2 * WORD + 1, 2 * MARK + 1), "line": (2 * BREAK, 2 * BREAK + 1)}


class BitVector:
    """Bits in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros(len(bits) // 64 + 1, "<u8")
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[:len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, rest = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Ranks over a sequence of values below ``2 ** levels``: a bit vector per level, zeros moved to the front."""

    def __init__(self, values: np.ndarray, levels: int):
        self.size, self.levels = len(values), []
        for level in reversed(range(levels)):
            bits = (values >> level) & 1 == 1
            self.levels.append((level, BitVector(bits), len(values) - int(np.count_nonzero(bits))))
            values = np.concatenate([values[~bits], values[bits]])

    def rank(self, value: int, i: np.ndarray) -> np.ndarray:
        """How often the value stands before each place."""
        low, high = np.zeros(1, np.int64), np.asarray(i, np.int64)
        for level, bits, zeros in self.levels:
            if value >> level & 1:
                low, high = zeros + bits.ones(low), zeros + bits.ones(high)
            else:
                low, high = low - bits.ones(low), high - bits.ones(high)
        return high - low


class Boundaries:
    """Unit ends in texts laid end to end; text t covers the code points ``starts[t]`` up to ``starts[t + 1]``."""

    def __init__(self, lead: np.ndarray, starts: np.ndarray, unit: str = "token"):
        kind = KIND[lead]
        solid = kind >= WORD
        ends = np.ones(len(lead), bool)
        ends[:-1] = solid[:-1] != solid[1:]
        ends[starts[1:][starts[1:] > starts[:-1]] - 1] = True
        self.starts, self.classes = starts.astype(np.int64), UNITS[unit]
        self.matrix = WaveletMatrix(2 * kind + ends, 3)
        self.base = self._ended(self.starts)
        closed = self.base[1:] - self.base[:-1]
        # code points behind the last end are one unit more
        last = np.maximum(self.starts[1:] - 1, self.starts[:-1])
        empty = self.starts[1:] == self.starts[:-1]
        ended = self._ended(self.starts[1:]) - self._ended(last)
        self.counts = closed + np.where(empty | (ended > 0), 0, 1)

    def _ended(self, i: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(c, i) for c in self.classes)

    def place(self, k: np.ndarray) -> np.ndarray:
        """For every text the number of its code points up to the end of its k-th unit (0: none)."""
        low, high = self.starts[:-1].copy(), self.starts[1:].copy()
        wanted = self.base[:-1] + k
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            reached = self._ended(middle) >= wanted
            high = np.where(open_ & reached, middle, high)
            low = np.where(open_ & ~reached, middle + 1, low)
        return low - self.starts[:-1]


def _buffers(texts):
    """(bytes, byte offsets) of an Arrow string column, null as empty."""
    import pyarrow as pa

    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    if texts.null_count and (np.diff(offsets)[np.asarray(texts.is_null())] > 0).any():
        return _buffers(texts.fill_null(b""))
    return data, offsets


def _slices(offsets: np.ndarray):
    """Ranges of texts that hold at most SLICE bytes, or one text."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def cut_places(texts, one, two, unit: str = "token"):
    """(units, end of the prefix, end of the middle) per text; the hashes choose the cuts modulo the units and one."""
    data, offsets = _buffers(texts)
    found = [np.zeros(len(texts), np.int64) for _ in range(3)]
    for first, last in _slices(offsets):
        at = offsets[first:last + 1]
        part = data[at[0]:at[-1]]
        begins = (part & 0xC0) != 0x80  # first bytes of code points
        before = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
        bounds = Boundaries(part[begins], before[at - at[0]], unit)
        picks = np.sort([one[first:last] % (bounds.counts + 1), two[first:last] % (bounds.counts + 1)], axis=0)
        for column, values in zip(found, (bounds.counts, bounds.place(picks[0]), bounds.place(picks[1]))):
            column[first:last] = values
    return found


def _hash(part: int, seed: int) -> Column:
    """The part-th group of eight hexadecimal digits of the document's hash, as a number."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 8 * part - 7, 8), 16, 10).cast("long")


def transform(documents: DataFrame, seed: int = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, unit: str = "token") -> DataFrame:
    """Documents with n (units), form (plain, psm, spm), prefix_chars, middle_chars and output."""

    @F.arrow_udf("struct<n: long, first: long, second: long>")
    def cuts(texts, one, two):
        import pyarrow as pa

        n, first, second = cut_places(texts, one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False), unit)
        return pa.StructArray.from_arrays([pa.array(n), pa.array(first), pa.array(second)], ["n", "first", "second"])

    kept = [c for c in documents.columns if c not in ADDED and c != "text"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(F.col("_text"), F.lit(sentinel))
    form = (
        F.when((F.col("_text") == "") | marked | (_hash(3, seed) % 100 >= 100 - plain), "plain")
        .when(_hash(4, seed) % 100 < suffix_first, "spm").otherwise("psm")
    )
    placed = documents.withColumn("_text", text).withColumn("_form", form).withColumn("_cut", cuts("_text", _hash(1, seed), _hash(2, seed)))
    first, second = F.col("_cut.first").cast("int"), F.col("_cut.second").cast("int")
    split = placed.withColumn("_parts", F.struct(
        F.substring("_text", F.lit(1), first).alias("prefix"),
        F.substring("_text", first + 1, second - first).alias("middle"),
        F.substring("_text", second + 1, F.lit(2 ** 31 - 1)).alias("suffix")))
    prefix, middle, suffix = (F.col(f"_parts.{c}") for c in ("prefix", "middle", "suffix"))
    output = (
        F.when(F.col("_form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("_form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("_text"))
    )
    cut = F.col("_form") != "plain"
    return split.select(
        *kept, "text", F.col("_cut.n").alias("n"), F.col("_form").alias("form"),
        F.when(cut, first.cast("long")).alias("prefix_chars"), F.when(cut, (second - first).cast("long")).alias("middle_chars"),
        output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from: the parts hold no sentinel, so the output splits at exactly three."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)

    def joined(prefix, middle, suffix):
        return F.concat(F.get(parts, F.lit(prefix)), F.get(parts, F.lit(middle)), F.get(parts, F.lit(suffix)))

    return F.when(form == "plain", output).when(form == "psm", joined(1, 3, 2)).otherwise(joined(2, 3, 1))


def digests(documents: DataFrame) -> DataFrame:
    """One row per document: the cuts, and digests of the output and of the text rebuilt from it."""
    made = transform(documents)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
