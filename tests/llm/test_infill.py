import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftline.llm import infill as I

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the definition."""
    text = text or ""
    units = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(df, rows):
    made = I.transform(df).withColumn("back", I.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made), key=repr)
    assert got == sorted(((r[0], *plain(r[0], r[1])) for r in rows), key=repr)
    assert sorted(r["back"] for r in made) == sorted(r[1] or "" for r in rows)
    return made


def odd_texts(n, seed=7):
    rng = random.Random(seed)
    pieces = ["a", "B7", "_", "é", "汉字", "\U0001F600", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", ".", "<", "<P", "S>", "M", "\0", "\x85", " ", " ", "x" * 90]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_against_plain_python(documents):
    rows = [(k, t) for k, t in enumerate(odd_texts(1500))]
    made = check(documents(rows), rows)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


def test_edges(documents):
    texts = [None, "", " ", "\n\n", "one", " one", "one ", "has <M> inside", "<<P", "ab<", "\U0001F600 \U0001F600"]
    rows = [(k, t) for k in range(30) for t in texts] + [(None, "null id here"), (None, "null id here"), (5, "one two"), (5, "one two")]
    check(documents(rows), rows)
    assert I.digests(documents([])).count() == 0


def test_very_long_texts(documents):
    long_one = "wörd " * 900_000 + "\n" * 5_000_000 + "x" * 6_000_000
    rows = [(k, t) for k, t in enumerate(["short text", long_one, "a b c", long_one[:5_000_000], "", "d e"])]
    check(documents(rows), rows)


def test_clashing_names_are_replaced(spark):
    df = spark.createDataFrame([(1, "a b c", "old", 9, "kept")], "doc_id long, text string, output string, n int, note string")
    row = I.transform(df).collect()[0]
    assert (row["n"], row["note"], row["output"]) == (3, "kept", plain(1, "a b c")[4])


def test_digests_are_of_the_texts(documents):
    rows = [(k, t) for k, t in enumerate(odd_texts(60, 3))]
    for r in I.digests(documents(rows)).collect():
        text = rows[r["doc_id"]][1]
        assert r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["output_sha256"] == hashlib.sha256(plain(r["doc_id"], text)[4].encode()).hexdigest()


def test_ranks_are_counts():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 1000):
        values = rng.integers(0, 8, size).astype(np.uint8)
        matrix = I.WaveletMatrix(values, 3)
        for v in range(8):
            assert matrix.rank(v, np.arange(size + 1)).tolist() == [int((values[:i] == v).sum()) for i in range(size + 1)]


def test_lines_are_units_too():
    texts = ["a\nb\n", "a\nb", "", "\n", "no end"]
    n, first, second = I.cut_places(pa.array(texts), np.array([1] * 5), np.array([9] * 5), "line")
    assert n.tolist() == [2, 2, 0, 1, 1]
    for t, k, a, b in zip(texts, n.tolist(), first.tolist(), second.tolist()):
        lines = t.splitlines(True)
        low, high = sorted((1 % (k + 1), 9 % (k + 1)))
        assert (a, b) == (len("".join(lines[:low])), len("".join(lines[:high])))


def test_slices_give_the_same_cuts(monkeypatch):
    texts = pa.array([None, *odd_texts(200, 5)])
    one, two = np.arange(201) * 7919 % 1013, np.arange(201) * 104729 % 997
    want = I.cut_places(texts, one, two)
    monkeypatch.setattr(I, "SLICE", 100)
    got = I.cut_places(texts, one, two)
    assert all((a == b).all() for a, b in zip(want, got))
    tail = I.cut_places(texts.slice(50), one[50:], two[50:])
    assert all((a[50:] == b).all() for a, b in zip(want, tail))
