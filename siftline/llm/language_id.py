"""Language identification by segmentation-marginalised unigrams.

A fixed public piece vocabulary gives the pieces; each language has a probability for every piece.  The probability of
a word in a language is the sum, over all its segmentations into pieces, of the product of their probabilities (forward
algorithm); a text's log probability is the sum over its words plus the language's prior.  Probabilities are fitted by
expectation maximisation (forward and backward) on words of a bounded sample of labelled rows.

Words are runs of letters and of the marks that follow them (vowel signs, accents) in the lower-cased text, longer ones cut into
spans of ``MAX_WORD`` characters; numerals such as a half or a Roman eight are no letters.  Pieces of up to ``MAX_PIECE`` characters
take part, so a longer piece of the vocabulary is spelt by its parts.  Whole texts are scored inside their task without a shuffle: each distinct word is scored once per worker and remembered up to a bound.

Defined results: a text that is null or holds no letter is ``und`` with score 0; without any labelled row everything
is ``und``, and ``accepted`` then keeps every text that holds a letter, as nothing speaks against it; repeated rows get equal results; ties go to the first language by name; further columns are ignored.
"""
import functools
import re
import unicodedata
import uuid

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_by_worker, stored

#: Labelled documents per language that the model is fitted on.
FIT_DOCUMENTS = 2000
#: Of these, documents that one share of a language's rows gives.
FIT_SHARE = 20
EM_ROUNDS = 3
SMOOTHING = 0.05
MAX_WORD = 40
MAX_PIECE = 16
#: Probability of a character outside the vocabulary.
UNKNOWN = 1e-7
#: Words remembered by one Python worker.
REMEMBER_WORDS = 600_000
UNDETERMINED = "und"
START = "▁"

#: A letter and the letters and marks behind it.  ``_letters_of_the_first_plane`` is the same for most texts, and faster.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_SPELT = regex.compile(r"[\p{L}\p{M}]*")
_HIGHER_PLANES = re.compile("[\U00010000-\U0010ffff]")


@functools.cache
def _letters_of_the_first_plane():
    def characters(*kinds):
        spans = []
        for code in range(0x10000):
            if unicodedata.category(chr(code))[0] in kinds:
                if spans and spans[-1][1] == code - 1:
                    spans[-1][1] = code
                else:
                    spans.append([code, code])
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans)

    return re.compile(f"[{characters('L')}][{characters('L', 'M')}]*")


def _runs(text: str) -> list:
    if _HIGHER_PLANES.search(text):
        return _LETTERS.findall(text)
    return _letters_of_the_first_plane().findall(text)


_pieces_cache = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> list:
    """Pieces of a sentencepiece vocabulary that can occur in lower-cased words."""
    if path not in _pieces_cache:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
        _pieces_cache[path] = sorted({p.lower() for p in found if _SPELT.fullmatch(p.removeprefix(START)) and len(p) <= MAX_PIECE} - {""})
    return _pieces_cache[path]


def words_of(text: str) -> list:
    """The words of a text: letters with their marks, lower-cased, in spans of at most MAX_WORD."""
    found = _runs(text.lower())
    if any(len(w) > MAX_WORD for w in found):
        found = [w[i:i + MAX_WORD] for w in found for i in range(0, len(w), MAX_WORD)]
    return found


class Lattice:
    """All pieces inside words of one length, looked up together."""

    FACTOR = 0x9E3779B97F4A7C15 | 1

    def __init__(self, pieces):
        import numpy as np

        self.pieces = list(pieces)
        self.max_piece = max((len(p) for p in self.pieces), default=1)
        hashes = np.array([self._hash(p) for p in self.pieces], "u8")
        self.order = np.argsort(hashes).astype("i4")
        self.hashes = hashes[self.order]

    def _hash(self, piece):
        h = 0
        for ch in piece:
            h = (h * self.FACTOR + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def grid(self, words):
        """{(start, end): piece number or -1 per word} for words of equal length; place 0 is the word's start mark."""
        import numpy as np

        n = len(words[0]) + 1
        codes = np.array([START + w for w in words]).view("u4").reshape(len(words), n).astype("u8") + np.uint64(1)
        found = {}
        for start in range(n):
            h = np.zeros(len(words), "u8")
            for end in range(start + 1, min(n, start + self.max_piece) + 1):
                h = h * np.uint64(self.FACTOR) + codes[:, end - 1]
                at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
                hit = self.hashes[at] == h if len(self.hashes) else np.zeros(len(words), bool)
                if hit.any() or end == start + 1:
                    found[start, end] = np.where(hit, self.order[at], -1)
        return n, found


def _step(table, pieces, length):
    """Probabilities (words, languages) of the pieces; a single unknown character has a small one, longer ones none."""
    import numpy as np

    got = table[pieces]
    return np.where((pieces < 0)[:, None], UNKNOWN if length == 1 else 0.0, got)


def forward(lattice, table, words):
    """Log probability of each word in each language, summed over all segmentations."""
    import numpy as np

    n, found = lattice.grid(words)
    alpha = [np.ones((len(words), table.shape[1]))] + [np.zeros((len(words), table.shape[1])) for _ in range(n)]
    for (start, end), pieces in sorted(found.items(), key=lambda x: x[0]):
        alpha[end] += alpha[start] * _step(table, pieces, end - start)
    return np.log(np.maximum(alpha[n], 1e-300))


def expected_counts(lattice, table, column, words, counts):
    """Expected uses of each piece in one language over counted words of equal length."""
    import numpy as np

    probabilities = table[:, column:column + 1]
    n, found = lattice.grid(words)
    edges = [(start, end, pieces, _step(probabilities, pieces, end - start)[:, 0]) for (start, end), pieces in sorted(found.items(), key=lambda x: x[0])]
    alpha = np.zeros((n + 1, len(words)))
    beta = np.zeros((n + 1, len(words)))
    alpha[0] = beta[n] = 1.0
    for start, end, _, p in edges:
        alpha[end] += alpha[start] * p
    for start, end, _, p in reversed(edges):
        beta[start] += beta[end] * p
    total = np.maximum(alpha[n], 1e-300)
    out = np.zeros(len(lattice.pieces))
    for start, end, pieces, p in edges:
        known = pieces >= 0
        np.add.at(out, pieces[known], (counts * alpha[start] * p * beta[end] / total)[known])
    return out


def _by_length(words):
    groups = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    return groups.values()


class Model:
    """Languages in order, their log priors and the table of piece probabilities."""

    def __init__(self, vocabulary, languages, priors, table):
        self.vocabulary, self.languages, self.priors, self.table = vocabulary, languages, priors, table


class Scorer:
    """Scores texts, remembering the scores of words."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(load_pieces(model.vocabulary))
        self._forget()

    def _forget(self):
        import numpy as np

        self.rows, self.scores, self.used = {}, np.zeros((4096, len(self.model.languages))), 0

    def _learn(self, words):
        import numpy as np

        for group in _by_length(words):
            for i in range(0, len(group), 20_000):
                part = group[i:i + 20_000]
                while self.used + len(part) > len(self.scores):
                    self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.scores[self.used:self.used + len(part)] = forward(self.lattice, self.model.table, part)
                self.rows.update(zip(part, range(self.used, self.used + len(part))))
                self.used += len(part)

    def predict(self, texts):
        """(language, score) per text; None and texts without letters are undetermined."""
        import numpy as np

        tokens = [words_of(t) if t else [] for t in texts]
        new = {w for found in tokens for w in found if w not in self.rows}
        if new and len(self.rows) + len(new) > REMEMBER_WORDS:
            self._forget()
            new = {w for found in tokens for w in found}
        if new:
            self._learn(sorted(new))
        for found in tokens:
            if not found or not self.model.languages:
                yield UNDETERMINED, 0.0
                continue
            rows = np.fromiter(map(self.rows.__getitem__, found), "i8", len(found))
            total = self.scores[rows].sum(axis=0) + self.model.priors
            best = int(total.argmax())
            yield self.model.languages[best], float(1.0 / np.exp(total - total[best]).sum())


def held_out(doc_id):
    """Documents that never take part in fitting."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3) == 1


def fit(documents: DataFrame, vocabulary: str | None = None, per_language: int = FIT_DOCUMENTS) -> Model:
    """Fit on at most ``per_language`` labelled documents of each language outside the held-out fold.

    The driver sees one number per language and piece, never words or texts.
    """
    import numpy as np

    vocabulary = vocabulary or default_vocabulary()
    labelled = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # a language may hold most rows: it is dealt to shares by hash, and each share gives an equal part of the sample
    shares = max(1, per_language // FIT_SHARE)
    dealt = labelled.select("lang", "doc_id", F.xxhash64("doc_id").alias("_hash")).withColumn("_share", F.pmod("_hash", F.lit(shares)))
    first = Window.partitionBy("lang", "_share").orderBy("_hash", "doc_id")
    picked = dealt.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= per_language // shares)
    picked = stored(picked.select(F.col("lang").alias("_lang"), F.col("doc_id").alias("_doc")).distinct(), "fit-ids")
    chosen = labelled.join(F.broadcast(picked), (F.col("lang") == F.col("_lang")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("lang", "text")

    def count(frames):
        import collections

        import pandas as pd

        for frame in frames:
            seen = collections.Counter((lang, w) for lang, text in zip(frame["lang"], frame["text"]) for w in words_of(text))
            yield pd.DataFrame([(lang, w, n) for (lang, w), n in seen.items()], columns=["lang", "word", "n"])

    words = stored(chosen.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "fit-words")
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    size = len(load_pieces(vocabulary))
    table = np.full((size + 1, max(1, len(languages))), 1.0 / max(1, size))
    table[-1] = 0.0
    place = {lang: k for k, lang in enumerate(languages)}
    for _ in range(EM_ROUNDS if languages else 0):
        current = table

        def expect(frames):
            import pandas as pd

            lattice = Lattice(load_pieces(vocabulary))
            sums = {}
            for frame in frames:
                for lang, part in frame.groupby("lang"):
                    counted = dict(zip(part["word"], part["n"]))
                    for group in _by_length(counted):
                        uses = expected_counts(lattice, current, place[lang], group, np.array([counted[w] for w in group], "f8"))
                        sums[lang] = sums.get(lang, 0) + uses
            for lang, uses in sums.items():
                at = np.flatnonzero(uses)
                yield pd.DataFrame({"lang": lang, "piece": at, "uses": uses[at]})

        uses = words.mapInPandas(expect, "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()
        table = np.full((size + 1, len(languages)), SMOOTHING)
        table[uses["piece"].to_numpy("i8"), uses["lang"].map(place).to_numpy("i8")] += uses["uses"].to_numpy("f8")
        table[-1] = 0.0
        table /= table.sum(axis=0)
    share = np.array([totals[lang] for lang in languages], "f8")
    return Model(vocabulary, languages, np.log(share / share.sum()) if languages else share, table)


def _predictions(spark, model: Model):
    """A function from an Arrow column of texts to (language, score) pairs, for use inside tasks."""
    held = spark.sparkContext.broadcast(model)  # one number per language and piece
    key = uuid.uuid4().hex

    def score(texts):
        scorer = kept_by_worker(("language", key), lambda: Scorer(held.value))
        found = []
        for i in range(0, len(texts), 256):
            found += scorer.predict(texts.slice(i, 256).to_pylist())
        return found

    return score


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    predictions = _predictions(documents.sparkSession, model)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            found = predictions(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    rows = documents.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame, vocabulary: str | None = None, per_language: int = FIT_DOCUMENTS) -> DataFrame:
    return predict(documents, fit(documents, vocabulary, per_language))


def accepted(documents: DataFrame, vocabulary: str | None = None, per_language: int = FIT_DOCUMENTS) -> DataFrame:
    """The documents, with all their columns, whose language is determined.

    Where no row is labelled there is no language to tell, and all texts with a letter stay.
    """
    model = fit(documents, vocabulary, per_language)
    if not model.languages:
        return documents.filter(F.col("text").rlike(r"\p{L}"))
    predictions = _predictions(documents.sparkSession, model)
    place = documents.columns.index("text")

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([lang != UNDETERMINED for lang, _ in predictions(batch.column(place))], pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
