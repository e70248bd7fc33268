import html
import re

import numpy as np
import pytest

from siftline.llm import block_labeller as B


def article(page):
    """The text between the article tags of the given pages' design."""
    parts = re.split(r"</?(?:p|br|h1)>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    texts = (" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in parts)
    return " ".join(t for t in texts if t)


@pytest.fixture(scope="module")
def pages(spark, folder):
    return spark.read.parquet(f"{folder}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return B.fit(pages, fit_pages=20)


def test_given_pages_outside_the_sample(spark, model):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: article(r["html"]) for r in df.collect()}
    got = {r["page_id"]: r for r in B.extract(df, model).collect()}
    assert len(got) == len(want)
    assert sum(got[k]["text"] == want[k] for k in want) >= 0.99 * len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_designed_pages_held_out(model):
    random, features = np.random.default_rng(77), B.Features()
    right = total = 0
    for _ in range(150):
        page = B.design(random, ["Here are some words.", "Other text follows this one.", "A third sentence stands here."])
        labels = np.array([y for _, y in page])
        right += ((model.scores(features.of([b for b, _ in page]), np.array([len(page)])) > 0) == labels).sum()
        total += len(labels)
    assert right / total > 0.97


def test_gradients_by_differences():
    random = np.random.default_rng(1)
    net = B.Labeller(size=5, hidden=3)
    net.w = {k: v.astype("f8") for k, v in net.w.items()}
    x, sizes, labels = random.normal(size=(9, 5)), np.array([4, 1, 4]), random.integers(0, 2, 9).astype("f8")

    def loss():
        p = B._sigmoid(net.scores(x, sizes).astype("f8"))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grad = net.gradients(x, sizes, labels)
    for name, place in (("xf", (0, 2)), ("hb", (1, 7)), ("bf", (4,)), ("ob", (2, 0)), ("c", (0,))):
        step, old = 1e-2, net.w[name][place]
        net.w[name][place] = old + step
        up = loss()
        net.w[name][place] = old - step
        down = loss()
        net.w[name][place] = old
        assert abs((up - down) / (2 * step) - grad[name][place]) < 2e-3


def test_blocks_of_odd_markup():
    texts = lambda page: [t for t, _, _ in B.leaves(page)]
    assert texts("") == [] and texts("a < b &amp; c") == ["a < b & c"]
    assert texts("<p>one<p>t<b>w</b>o<br>three<!-- no --><script>var x='<p>'</script>") == ["one", "two", "three"]
    assert texts("<ul><li>x<li>y</ul><style>p{}</style>\n z&nbsp;\t&eacute;") == ["x", "y", "z é"]
    assert texts("<title>no</title><p title='a>b'>yes</p><div") == ["yes", "<div"]
    assert texts("<!-- open <p>no") == [] and texts("<script>open") == []
    assert [p[-1] for _, p, _ in B.leaves('<div class="siteHeader ad-box">x')] == [("div", ".site", ".header", ".ad", ".box")]


def test_edges(spark, model):
    rows = [(1, "u", None, 3), (2, None, "", 3), (None, "u", "<article><p>Some text of the article. It goes on here.</p></article>", 3), (4, "v", "<script>x</script>", 3), (4, "v", "<script>x</script>", 3),
            (5, "w", "<p>word</p>" * 20_000, 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = B.extract(df, model).collect()
    assert len(got) == len(rows)
    assert {r["text"] for r in got if r["page_id"] in (1, 2, 4)} == {""}
    assert [r["text"] for r in got if r["page_id"] is None] == ["Some text of the article. It goes on here."]
    assert B.main_texts(df.limit(0)).count() == 0


def plain_scores(net, x):
    """One page's log odds, one block, gate and unit at a time."""
    out = np.full(len(x), float(net.w["c"][0]))
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        h, c = [0.0] * net.hidden, [0.0] * net.hidden
        for t in order:
            z = [float(net.w["b" + d][k] + x[t] @ net.w["x" + d][:, k] + sum(h[j] * net.w["h" + d][j, k] for j in range(net.hidden))) for k in range(4 * net.hidden)]
            i, f, o, g = (z[k * net.hidden:(k + 1) * net.hidden] for k in range(4))
            c = [sigmoid(f[j]) * c[j] + sigmoid(i[j]) * np.tanh(g[j]) for j in range(net.hidden)]
            h = [sigmoid(o[j]) * np.tanh(c[j]) for j in range(net.hidden)]
            out[t] += sum(h[j] * net.w["o" + d][j, 0] for j in range(net.hidden))
    return out


def test_scores_against_a_plain_network():
    random = np.random.default_rng(5)
    net = B.Labeller(size=6, hidden=3, seed=2)
    sizes = np.array([3, 1, 7, 7, 2])
    x = random.normal(size=(20, 6)).astype("f4")
    got, at = net.scores(x, sizes), 0
    for size in sizes:
        assert np.allclose(got[at:at + size], plain_scores(net, x[at:at + size]), atol=1e-5)
        at += size


def test_pages_do_not_depend_on_their_batch(model):
    random, features = np.random.default_rng(8), B.Features()
    pages = [[b for b, _ in B.design(random, ["Some words here.", "And others there follow."])] for _ in range(60)]
    together = model.scores(features.of([b for p in pages for b in p]), np.array([len(p) for p in pages]))
    alone = np.concatenate([model.scores(features.of(p), np.array([len(p)])) for p in pages])
    stretched = np.concatenate([model.long_scores(features, p, stretch=4) for p in pages])
    assert np.allclose(together, alone, atol=1e-4) and np.allclose(together, stretched, atol=1e-4)


def test_memory_follows_the_blocks(model):
    import tracemalloc

    sizes = np.array([10] * 2000 + [30_000])
    x = np.zeros((sizes.sum(), B.PATH_SIZE + B.WORD_SIZE + B.MEASURES), "f4")
    tracemalloc.start()
    model.scores(x, sizes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6  # the terms of 50 000 blocks are 19 MB; padded to the longest page they would be 23 GB


def test_whole_sampled_pages_and_long_ones_passed_over(spark):
    tail = "".join(f"<p>Sentence number {k} of the article stands here.</p>" for k in range(90))
    page = "<nav><a>menu</a></nav><article>" + tail + "</article><footer>end of all</footer>"
    rows = [(k, "u", page) for k in range(3)] + [(9, "u", "<p>x</p>" * (B.FIT_BLOCKS + 1))]
    seen, fit = [], B.Labeller.fit
    try:
        B.Labeller.fit = lambda self, data: seen.append(data) or self
        B.fit(spark.createDataFrame(rows, "page_id long, url string, html string"), designed=2)
    finally:
        B.Labeller.fit = fit
    assert [len(y) for _, y in seen[0]][:1] == [92] and len(seen[0]) == 3
    assert seen[0][0][1].tolist() == [0] + [1] * 90 + [0]


def test_framed_adverts_and_form_parts(model):
    path = lambda page: [[e[0] for e in p] for _, p, _ in B.leaves(page)]
    assert path("<p>a <ins>b</ins> c</p>") == [["p"]]
    assert path('<div>a<ins class="adsbygoogle">buy</ins>c</div>') == [["div"], ["div", "ins"], ["div"]]
    page = "<article><h1>Title of it</h1>" + "".join(f"<p>Sentence {k} of this article stands here. It goes on.</p>" for k in range(6))
    for odd in ('<ins class="adsbygoogle">Buy this now</ins>', "<button>Subscribe</button>", "<form><textarea>Your words</textarea></form>"):
        blocks = B.leaves(page + odd + "<p>Last sentence of the article is here.</p></article>")
        labels = model.scores(B.Features().of(blocks), np.array([len(blocks)])) > 0
        assert labels[-1] and not labels[-2], odd
