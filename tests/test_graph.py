"""Code graphs: centrality by blocks of sources and the findings it locates."""
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.operators import graph as G
from siftline.operators import model_findings as M


def betweenness(n, links):
    """Accumulates shortest-path counts backwards from every source, in whole numbers."""
    following = [[] for _ in range(n)]
    for a, b in links:
        following[a].append(b)
    score = [0.0] * n
    for source in range(n):
        paths, depth, parents = [0] * n, [-1] * n, [[] for _ in range(n)]
        paths[source], depth[source] = 1, 0
        visited, queue = [], deque([source])
        while queue:
            v = queue.popleft()
            visited.append(v)
            for w in following[v]:
                if depth[w] < 0:
                    depth[w] = depth[v] + 1
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
                    parents[w].append(v)
        share = [0.0] * n
        for w in reversed(visited):
            for v in parents[w]:
                share[v] += paths[v] / paths[w] * (1.0 + share[w])
            if w != source:
                score[w] += share[w]
    scale = (n - 1) * (n - 2)
    return [s / scale for s in score] if scale > 0 else score


def forward_links(rng, n, extra):
    links = {(i, i + 1) for i in range(n - 1)} if rng.random() < 0.8 else set()
    while n > 1 and len(links) < n - 1 + extra:
        links.add(tuple(sorted(rng.sample(range(n), 2))))
    return sorted(links)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_shares_add_up_to_betweenness(block):
    rng = random.Random(block)
    for n in (1, 2, 3, 4, 9, 25, 40):
        links = forward_links(rng, n, rng.randrange(n + 3) if n > 4 else 0)
        preds = G.predecessors(n, *zip(*links)) if links else G.predecessors(n, [], [])
        total = sum(G.through_shares(preds, k, min(k + block, n)) for k in range(0, n, block))
        scale = (n - 1) * (n - 2)
        assert np.allclose(total / scale if scale > 0 else total, betweenness(n, links))


def test_path_counts_beyond_a_float():
    # a chain of 1100 diamonds has 2 ** 1100 shortest paths
    links = [e for k in range(1100) for e in ((3 * k, 3 * k + 1), (3 * k, 3 * k + 2), (3 * k + 1, 3 * k + 3), (3 * k + 2, 3 * k + 3))]
    preds = G.predecessors(3301, *zip(*links))
    share = G.through_shares(preds, 0, 1)
    # the first branch lies on half of the paths to every node of the 1099 other diamonds and to the end of its own
    assert share[1] == pytest.approx(0.5 * (3 * 1099 + 1))
    assert share[3] == pytest.approx(3 * 1099)


def test_links_lead_forward():
    with pytest.raises(ValueError):
        G.predecessors(3, [2], [1])


def corpus(spark, *contents):
    rows = [(k, f"f{k}.py", "python", c) for k, c in enumerate(contents)]
    return spark.createDataFrame(rows, "file_id long, file_path string, language string, content string")


def long_text(lines):
    rng = random.Random(lines)
    return "\n".join(rng.choice([f"v{rng.randrange(30)} = {k}", f"call(v{rng.randrange(30)})", f"x = call(v{rng.randrange(30)})", "", "# note", "if a:", f"return v{rng.randrange(30)}"])
                     for k in range(lines))


def test_long_files_are_dealt_to_tasks(spark):
    df = corpus(spark, long_text(400), "", "one", "a = 1\nb = 2\nprint(a)\nprint(b)", long_text(90))
    whole = {(r.file_id, r.id): (r.line, r.centrality) for r in G.line_centrality(df).collect()}
    dealt = G.line_centrality(df, long_file=50, cells=4000)
    got = {(r.file_id, r.id): (r.line, r.centrality) for r in dealt.collect()}
    assert whole and got.keys() == whole.keys()
    assert all(got[k][0] == whole[k][0] and abs(got[k][1] - whole[k][1]) < 1e-12 for k in whole)
    flat = {r.file_id: r for r in G._links(df, "file_id").collect()}
    for k, r in flat.items():
        want = betweenness(len(r.lines), list(zip(r.src, r.dst)))
        assert all(abs(got.get((k, i), (0, 0))[1] - w) < 1e-12 for i, w in enumerate(want))
    assert sum(n > 9 for n in (len(flat[0].lines) * len(flat[0].lines) // 4000,))  # the long file takes many blocks


def test_findings_span_the_central_lines(spark):
    text = "import os\n" + "\n".join(f"a{k} = {k}" for k in range(6)) + "\ncall(a0)"
    df = corpus(spark, text, "short")
    hot = {r.file_id: r.hot for r in G.hot_lines(df).collect()}
    assert list(hot) == [0] and hot[0] == sorted(set(hot[0])) and len(hot[0]) <= 5
    scored = df.join(G.hot_lines(df), "file_id", "left").selectExpr(
        "*", "'XSS' AS vulnerability_type", "0.9D AS score", "0.5D AS type_confidence", "0.1D AS graph_density", "0.1D AS suspicious_ratio")
    found = {r.file_path: r for r in M.graph_findings(scored).collect()}
    lines = text.split("\n")
    first, last = hot[0][0], hot[0][-1]
    assert (found["f0.py"].line_start, found["f0.py"].line_end) == (first, last)
    assert found["f0.py"].code_snippet == "\n".join(lines[max(0, first - 3):last + 2])
    assert (found["f1.py"].line_start, found["f1.py"].line_end, found["f1.py"].code_snippet) == (1, 1, "[No specific location identified]")


def test_names_are_looked_up_in_long_files(spark):
    rng = random.Random(8)
    odd = "\n".join(rng.choice(["a = b", "ab = aab(a)", "x[0] = ab", "return x[0]", "é = call(ab)", "print(é, a)", "== = a", "if a == b:", "bab(aab(x))", "int q = 5", "use(int q)"]) for _ in range(70))
    df = corpus(spark, long_text(60), odd, "", "\n\n", "one = 1")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(G.definition_edges(df)) == rows(G.definition_edges(df, long_file=0)) != []
    flat = lambda d: rows(d.select("file_id", "id", F.array_sort(F.transform("targets", lambda t: F.concat_ws(":", t["kind"], t["key"]))).alias("t")).selectExpr("file_id", "id", "concat_ws(',', t)"))
    assert flat(G._edge_ends(df)) == flat(G._edge_ends(df, long_file=0)) != []


def test_lookup_finds_every_name_and_no_other(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab(x ") for _ in range(n))
    names = [(k % 2, word(rng.randrange(6))) for k in range(40)]
    lines = [(k % 2, k, word(rng.randrange(14))) for k in range(50)]
    found = G.names_in_lines(spark.createDataFrame(names, "file_id long, name string"), spark.createDataFrame(lines, "file_id long, id int, text string"))
    want = {(f, n, k) for f, n in names for g, k, t in lines if f == g and n and n in t}
    got = [(r.file_id, r.name, r.id) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
