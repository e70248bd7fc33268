import hashlib
import random
from collections import defaultdict

from siftline.llm import cuckoo_dedup as C


def digest(k):
    return hashlib.sha256(str(k).encode()).digest()


def test_index_against_a_dict():
    random.seed(3)
    index, plain = C.CuckooIndex(4), {}
    for _ in range(30_000):
        k = random.randrange(3000)
        if k in plain and random.random() < 0.5:
            assert index.delete(digest(k))
            del plain[k]
        elif k not in plain:
            plain[k] = random.random()
            index.insert(digest(k), plain[k])
        assert index.find(digest(k)) == plain.get(k) and len(index) == len(plain)
    assert dict(index.items()) == {digest(k): v for k, v in plain.items()}
    assert not index.delete(digest("none"))


def test_equal_fingerprints_are_verified():
    index, a = C.CuckooIndex(4), digest(1)
    twin = a[:16] + b"\0" * 16
    index.insert(a, "a")
    assert index.find(twin) is None
    index.insert(twin, "t")
    assert index.find(a) == "a" and index.find(twin) == "t" and index.delete(a) and index.find(twin) == "t"


def test_groups(documents):
    rows = [(1, "Abc"), (2, "aBC"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 200_000), (8, "X" * 200_000), (9, "r"), (9, "r"), (None, "abc"), (None, None)]
    rows += [(100 + k, "copy") for k in range(500)]
    got = C.exact_groups(documents(rows)).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for doc, text in rows:
        groups["".join(c.lower() if c.isascii() else c for c in text or "")].append(doc)
    for r in got:
        text = next(t for t, ids in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        keep = max((d for d in groups[text] if d is not None), default=None)
        assert r["keep_id"] == keep and r["group_size"] == len(groups[text]) and r["doc_id"] in groups[text]
    assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_full_indexes_hand_on_summaries(documents, monkeypatch):
    rows = [(k, f"t{k % 40}") for k in range(400)]
    assert {r["group_size"] for r in C.exact_groups(documents(rows)).collect()} == {10}
    assert C.exact_groups(documents([])).count() == 0
