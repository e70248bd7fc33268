import hashlib
import re
from collections import defaultdict

from siftline.llm import source_mix as M


def plain(rows):
    """Targets by water filling and documents by hash, in plain Python."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
    source_of = [(r[3] if len(r) > 3 else None) for r in rows]
    own = defaultdict(int)
    for s, n in zip(source_of, sizes):
        own[s] += n
    order = sorted(own, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    free, left, target = set(order), float(sum(sizes)), {}
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 3 * own[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * own[s]
            left -= 3 * own[s]
        free -= over
    target |= {s: weight[s] * level for s in free}
    taken = [0] * len(rows)
    hashes = [int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16) for r in rows]
    for s in order:
        times = int(target[s] // own[s]) if own[s] else 0
        rest, before, groups = target[s] - times * own[s], 0, defaultdict(list)
        for k, h in enumerate(hashes):
            if source_of[k] == s:
                groups[h].append(k)
        for h in sorted(groups):
            words = sum(sizes[k] for k in groups[h])
            more = rest > 0 and 2 * before + words <= 2 * rest
            before += words
            for k in groups[h]:
                taken[k] = sizes[k] * (times + more)
    return sorted(((r[0], sizes[k], own[source_of[k]], round(target[source_of[k]], 6), taken[k]) for k, r in enumerate(rows)), key=repr)


def check(documents, rows):
    got = M.mix(documents(rows)).collect()
    assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got), key=repr) == plain(rows)
    return got


def test_against_plain_python(documents):
    rows = [(k, "w " * (k % 7 + 1), "en", f"s{k % 11}" if k % 11 else None) for k in range(400)]
    rows += [(k, "much text " * 200, "en", "hot") for k in range(400, 600)] + [(1, "again and again", "en", "é"), (1, "again and again", "en", "é")]
    got = check(documents, rows)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    hot = [r for r in got if (r["doc_id"] or 0) >= 400]
    assert abs(sum(r["taken"] for r in hot) - hot[0]["target"]) <= 200


def test_edges(documents):
    check(documents, [(1, None, "en", None), (2, "", "en", "a"), (None, "b c", "en", "b"), (None, "b c", "en", "b"), (3, "x y", "en", "a")])
    check(documents, [(1, "", "en", "a")])
    assert M.mix(documents([])).count() == 0 and M.mixed(documents([])).count() == 0


def test_mixed_rows_are_the_passes(documents):
    df = documents([(k, "w " * (k % 5 + 1), "en", f"s{k % 4}") for k in range(60)])
    want = {r["doc_id"]: r["repeats"] for r in M.mix(df).collect()}
    got = M.mixed(df)
    assert got.columns == df.columns
    counts = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {k: n for k, n in want.items() if n}
