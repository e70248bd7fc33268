import random
import re

import numpy as np

from siftline.llm import ngram_join as N
from siftline.llm import shingles as S


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)}


def plain_groups(rows):
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                label[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), doc), doc)
    return sorted((doc, len(sets[k]), least[find(k)]) for k, (doc, _) in enumerate(rows))


def check(documents, rows):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.near_duplicates(documents(rows)).collect())
    assert got == plain_groups(rows)


def edited(words, edits):
    words = list(words)
    for _ in range(edits):
        k = random.randrange(len(words))
        words[k] = f"e{random.randrange(10**6)}"
    return " ".join(words)


def test_against_all_pairs(documents):
    random.seed(8)
    passage = " ".join(f"c{k}" for k in range(30))
    rows, n = [], 0
    for group in range(12):
        base = [f"w{random.randrange(50_000)}" for _ in range(random.choice([3, 8, 40, 60, 150, 300]))]
        for _ in range(random.choice([1, 2, 6, 15])):
            text = edited(base, random.randrange(4))
            rows.append((n, f"{passage} {text}" if group % 3 == 0 else text))
            n += 1
    rows += [(n + k, passage + f" tail{k}") for k in range(25)]
    random.shuffle(rows)
    check(documents, rows)


def test_edges(documents):
    long = " ".join(f"v{k}" for k in range(30_000))
    check(documents, [(1, None), (2, ""), (3, "  \n"), (4, "A b"), (5, "a\tB"), (6, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (8, long), (9, long + " end"), (10, "é É"), (11, "a b")])
    assert N.near_duplicates(documents([])).count() == 0
    null = N.near_duplicates(documents([(None, "one two three"), (3, "other")])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in null} == {(None, None), (3, 3)}


def test_one_document_of_each_group_stays(documents):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "z y"), (4, None), (5, ""), (1, "a b c d e f")]
    df = documents(rows)
    got = N.without_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4, 5]


def test_shingle_hashes_follow_the_words():
    random.seed(2)
    texts = ["".join(random.choices("aB \n\té", k=random.randrange(60))) for _ in range(300)] + ["a b c d", "a b c", "x" * 3_000_000 + " y"]
    sets = list(S.shingle_sets([t.encode() for t in texts]))
    named = {}
    for t, s in zip(texts, sets, strict=True):
        assert len(s) == len(plain_set(t))
        key = frozenset(plain_set(t))
        assert named.setdefault(key, s.tobytes()) == s.tobytes()
    assert len(set(named.values())) == len(named)


def test_prefix_puts_common_shingles_last():
    s = np.sort(np.random.default_rng(0).integers(0, 1 << 60, 50, dtype="u8"))
    common = (s[:45].copy(), np.arange(45)[::-1].astype("i8") + 5)
    tokens, counts = N.prefix_of(s, common)
    assert len(tokens) == 50 - 40 + N.MAX_LEVEL and set(tokens[:5]) == set(s[45:]) and (np.diff(counts[5:]) >= 0).all()
