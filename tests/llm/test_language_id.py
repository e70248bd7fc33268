import itertools
import math

import numpy as np

from siftline.llm import language_id as L


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    lattice, random = L.Lattice(pieces), np.random.default_rng(0)
    table = np.vstack([random.random((len(pieces), 2)), np.zeros((1, 2))])
    for word in ("a", "ab", "abba", "xab", "bbbb"):
        full = L.START + word
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(full) - 1):
            parts, start = [], 0
            for k, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(full[start:k])
                    start = k
            p = np.ones(2)
            for part in parts:
                p = p * (table[pieces.index(part)] if part in pieces else L.UNKNOWN if len(part) == 1 else 0)
            total += p
        assert np.allclose(L.forward(lattice, table, [word])[0], np.log(total))
        uses = L.expected_counts(lattice, table, 0, [word], np.array([2.0]))
        lengths = np.array([len(p) for p in pieces])
        assert (uses * lengths).sum() <= 2 * len(full) + 1e-9


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(df, per_language=60).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 and math.isfinite(r["score"]) for r in got)


def test_edges(documents):
    rows = [(k, "the words of this text are here and there", "en") for k in range(30)] + [(k, "die worte und der text sind hier nicht da", "de") for k in range(30, 60)]
    rows += [(60, None, "en"), (61, "", "de"), (62, "123 !? \U0001F600", "en"), (None, "und der text", None), (63, "x" * 5000, None), (64, "der " * 100_000, "de"), (64, "der " * 100_000, "de")]
    df = documents(rows)
    got = L.identify(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert {by[k]["lang_pred"] for k in (60, 61, 62)} == {"und"} and by[60]["score"] == 0
    assert by[None]["lang_pred"] == "de" and by[64]["lang_pred"] == "de"
    kept = L.accepted(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert {r["lang_pred"] for r in L.identify(documents([(1, "words", None)])).collect()} == {"und"}
    assert L.identify(documents([])).count() == 0


def test_letters_and_marks():
    assert L.words_of("हिन्दी भाषा") == ["हिन्दी", "भाषा"]
    assert L.words_of("ภาษาไทยที่นี่") == ["ภาษาไทยที่นี่"]
    assert L.words_of("مُحَمَّد") == ["مُحَمَّد"]
    assert L.words_of("e\u0301te\u0301 \u0301x") == ["e\u0301te\u0301", "x"]
    assert L.words_of("½ ² Ⅷ ٣ 12_34 ①") == [] and L.words_of("a½b_c1d") == ["a", "b", "c", "d"]
    assert any("\u093f" in p for p in L.load_pieces(L.default_vocabulary()))


def test_scripts_with_marks(documents):
    hindi, thai, arabic = "यह हिन्दी में लिखा गया पाठ है", "นี่คือข้อความภาษาไทยที่เขียนไว้", "هٰذَا نَصٌّ مَكْتُوبٌ بِالْعَرَبِيَّةِ"
    rows = [(3 * k + n, f"{t} {k % 7}", lang) for k in range(40) for n, (t, lang) in enumerate(((hindi, "hi"), (thai, "th"), (arabic, "ar")))]
    got = {r["doc_id"]: r["lang_pred"] for r in L.identify(documents([*rows, (500, "½ ² Ⅷ", None)])).collect()}
    assert all(got[i] == lang for i, _, lang in rows) and got[500] == "und"


def test_nothing_is_dropped_without_labels(documents):
    df = documents([(1, "clean text", None), (2, "noch ein Text", None), (3, "12 ½ !", None), (4, None, None), (5, "हिन्दी", None)])
    assert sorted(r["doc_id"] for r in L.accepted(df).collect()) == [1, 2, 5]


def test_ties_go_to_the_first_language(documents):
    rows = [(k, "same words in both", lang) for k in range(60) for lang in ("zz", "aa")]
    assert {r["lang_pred"] for r in L.identify(documents(rows)).collect()} == {"aa"}


def test_expected_counts_against_all_segmentations():
    pieces, random = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"], np.random.default_rng(4)
    lattice, table = L.Lattice(pieces), np.vstack([random.random((len(pieces), 1)), np.zeros((1, 1))])
    for word, seen in (("abba", 3.0), ("aab", 1.0), ("bxab", 2.0)):
        full, weights, uses = L.START + word, 0.0, np.zeros(len(pieces))
        for cuts in itertools.product([0, 1], repeat=len(full) - 1):
            ends = [k for k, c in enumerate([*cuts, 1], 1) if c]
            parts = [full[a:b] for a, b in zip([0, *ends], ends)]
            p = math.prod(table[pieces.index(x), 0] if x in pieces else L.UNKNOWN if len(x) == 1 else 0 for x in parts)
            weights += p
            for x in parts:
                if x in pieces:
                    uses[pieces.index(x)] += p
        assert np.allclose(L.expected_counts(lattice, table, 0, [word], np.array([seen])), seen * uses / weights)
