"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks.  A block is a vector of its hashed tag path (tags, class and id words of its
ancestors), its hashed words and a few measures of its text.  A bidirectional LSTM in numpy reads the whole sequence
and labels every block with the document around it; the main blocks' texts are the page's text.

The model is fitted on the driver on a bounded sample of whole pages: at most ``FIT_PAGES`` of those with at most ``FIT_BLOCKS``
blocks.  Pages whose own markup names the article (``article`` or ``main``) give silver labels, and the same pages' words are
laid into varied page designs whose labels are known by construction, so that menus, sidebars, notices, adverts, forms and
comments are learned under many names.  Features of sampled pages are made in tasks from whole blocks.

Labelling holds one row of terms per block and one state per page, so memory follows the blocks of a batch whatever their
pages' lengths; a page of more than ``LABEL_BLOCKS`` blocks is read in stretches of that many, once in either direction.

Defined results: a null, empty or textless page gives an empty text; text outside tags is a block; unclosed tags end with
their parent; a page of one block is labelled like any other; repeated rows get equal results; an empty table gives an
empty result; further columns are ignored.
"""
import html
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: Pages the model is fitted on, designed pages added, most blocks of a page that may be in the sample.
FIT_PAGES, DESIGNED_PAGES, FIT_BLOCKS = 150, 450, 500
#: Sentences that a sampled page lends to the designed ones, and their longest.
FIT_SENTENCES, FIT_SENTENCE = 200, 400
EPOCHS, BATCH, HIDDEN, RATE = 12, 24, 24, 0.01
PATH_SIZE, WORD_SIZE, MEASURES = 192, 24, 6
#: Blocks labelled together by one task.
LABEL_BLOCKS = 20_000

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never shown text.
HIDDEN_TAGS = frozenset("script style title template svg".split())
#: An opening tag that ends an open element of the second set.
#: Inline elements that stand for themselves when they have a class, such as a framed advert.
FRAMED = frozenset({"ins"})
ENDS = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
SCOPES = frozenset("ul ol table dl select body article section div".split())


def _element(tag, attributes):
    """A tag with the words of its class, id and role."""
    words = [tag]
    if attributes and "=" in attributes:
        for _, a, b, c in _NAMES.findall(attributes):
            words += ["." + w.lower() for w in _PARTS.findall(a or b or c)]
    return tuple(words)


def leaves(page: str) -> list:
    """(text, path, share of linked characters) of every block that shows text."""
    out, stack, pieces, linked, in_link, at, size = [], [], [], 0, False, 0, len(page)

    def flush():
        nonlocal linked
        if pieces:
            text = "".join(pieces)
            pieces.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append((text, tuple(stack), min(1.0, linked / len(text))))
            linked = 0

    def show(text):
        nonlocal linked
        pieces.append(text)
        linked += len(text) if in_link else 0

    while at < size:
        start = page.find("<", at)
        if start < 0:
            show(page[at:])
            break
        if start > at:
            show(page[at:start])
        m = _TOKEN.match(page, start)
        if m is None:
            show("<")
            at = start + 1
            continue
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m[1] or m[4])
        if tag in HIDDEN_TAGS and not closing:
            if not (m[3] or m[6] or "").endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        framed = tag in FRAMED and (any(e[0] == tag for e in stack) if closing else len(_element(tag, m[3] or m[6])) > 1)
        if tag in INLINE and not framed:
            if tag == "a":
                in_link = not closing
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        if tag in ENDS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ENDS[tag]:
                    del stack[k:]
                    break
                if stack[k][0] in SCOPES:
                    break
        if tag not in VOID:
            stack.append(_element(tag, m[3] or m[6]))
    flush()
    return out


class Features:
    """Vectors of blocks; paths and words are hashed, and remembered up to a bound."""

    def __init__(self):
        self.paths, self.words = {}, {}

    def _path(self, path):
        import numpy as np

        if path not in self.paths:
            if len(self.paths) > 50_000:
                self.paths.clear()
            v = np.zeros(PATH_SIZE, "f4")
            for depth, element in enumerate(reversed(path)):
                for word in element:
                    for mark in ("", "^") if depth == 0 else ("",):
                        h = zlib.crc32((mark + word).encode())
                        v[h % PATH_SIZE] += 1.0 if h & 0x80000000 else -1.0
            self.paths[path] = v
        return self.paths[path]

    def _word(self, word):
        if len(self.words) > 300_000:
            self.words.clear()
        found = self.words[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_SIZE
        return found

    def of(self, blocks):
        import numpy as np

        x = np.zeros((len(blocks), PATH_SIZE + WORD_SIZE + MEASURES), "f4")
        known = self.words
        for k, (text, path, linked) in enumerate(blocks):
            words = text.split(" ")
            x[k, :PATH_SIZE] = self._path(path)
            places = [known[w] if w in known else self._word(w) for w in words]
            x[k, PATH_SIZE:PATH_SIZE + WORD_SIZE] = np.bincount(places, minlength=WORD_SIZE) / len(words)
            x[k, PATH_SIZE + WORD_SIZE:] = (
                np.log1p(len(words)) / 4, linked, text.count(".") / len(words), text[-1] in ".!?", text[0].isupper(), len(text) / len(words) / 10)
        return x


def _sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output per block."""

    def __init__(self, size=PATH_SIZE + WORD_SIZE + MEASURES, hidden=HIDDEN, seed=7):
        import numpy as np

        random = np.random.default_rng(seed)
        self.hidden, self.w = hidden, {}
        for d in "fb":
            self.w["x" + d] = (random.normal(size=(size, 4 * hidden)) / np.sqrt(size)).astype("f4")
            self.w["h" + d] = (random.normal(size=(hidden, 4 * hidden)) / np.sqrt(hidden)).astype("f4")
            self.w["b" + d] = np.repeat(np.array([0, 1, 0, 0], "f4"), hidden)
            self.w["o" + d] = (random.normal(size=(hidden, 1)) / np.sqrt(hidden)).astype("f4")
        self.w["c"] = np.zeros(1, "f4")

    def _step(self, z, h, c, d):
        """One step from input terms and the states before it: gates, cell and new states."""
        import numpy as np

        hidden = self.hidden
        gates = z + h @ self.w["h" + d]
        i, f, o = (_sigmoid(gates[:, k * hidden:(k + 1) * hidden]) for k in range(3))
        g = np.tanh(gates[:, 3 * hidden:])
        cell = f * c + i * g
        tanh_cell = np.tanh(cell)
        return (i, f, o, g, tanh_cell), o * tanh_cell, cell

    @staticmethod
    def _steps(sizes, d):
        """Per step the rows of all pages that are long enough, longest page first."""
        import numpy as np

        order = np.argsort(-sizes, kind="stable")
        ends = np.cumsum(sizes)[order]
        begins, falling = ends - sizes[order], sizes[order]
        alive = len(sizes)
        for t in range(int(falling[0])):
            while falling[alive - 1] <= t:
                alive -= 1
            yield begins[:alive] + t if d == "f" else ends[:alive] - 1 - t

    def scores(self, x, sizes, keep=None):
        """Log odds of being main text for the rows of x, the blocks of pages with these sizes."""
        import numpy as np

        total = np.full(len(x), self.w["c"][0], x.dtype)
        for d in "fb":
            z = x @ self.w["x" + d] + self.w["b" + d]
            h = np.zeros((len(sizes), self.hidden), z.dtype)
            c = h.copy()
            states = []
            for rows in self._steps(sizes, d):
                a = len(rows)
                gates, after, cell = self._step(z[rows], h[:a], c[:a], d)
                if keep is not None:
                    states.append((rows, *gates, c[:a].copy(), h[:a].copy(), after))
                h[:a], c[:a] = after, cell
                total[rows] += (after @ self.w["o" + d])[:, 0]
            if keep is not None:
                keep[d] = states
        return total

    def long_scores(self, features, blocks, stretch=LABEL_BLOCKS):
        """The same for one page, whose features are made a stretch of blocks at a time."""
        import numpy as np

        total = np.full(len(blocks), self.w["c"][0], "f4")
        cuts = [(k, min(k + stretch, len(blocks))) for k in range(0, len(blocks), stretch)]
        for d in "fb":
            h = np.zeros((1, self.hidden), "f4")
            c = h.copy()
            for low, high in cuts if d == "f" else cuts[::-1]:
                z = features.of(blocks[low:high]) @ self.w["x" + d] + self.w["b" + d]
                for k in range(high - low) if d == "f" else range(high - low - 1, -1, -1):
                    _, h, c = self._step(z[k:k + 1], h, c, d)
                    total[low + k] += (h @ self.w["o" + d])[0, 0]
        return total

    def gradients(self, x, sizes, labels):
        """Gradients of the mean cross entropy by back-propagation through time."""
        import numpy as np

        keep, hidden = {}, self.hidden
        error = (_sigmoid(self.scores(x, sizes, keep)) - labels) / len(labels)
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["c"][0] = error.sum()
        for d in "fb":
            dz_rows = np.zeros((len(x), 4 * hidden), x.dtype)
            dh_next, dc_next = np.zeros((len(sizes), hidden), x.dtype), np.zeros((len(sizes), hidden), x.dtype)
            for rows, i, f, o, g, tc, before, h_before, after in reversed(keep[d]):
                a, e = len(rows), error[rows]
                grad["o" + d][:, 0] += e @ after
                dh = dh_next[:a] + e[:, None] * self.w["o" + d][:, 0]
                dc = dc_next[:a] + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                grad["h" + d] += h_before.T @ dz
                dh_next[:a], dc_next[:a] = dz @ self.w["h" + d].T, dc * f
                dz_rows[rows] = dz
            grad["x" + d] = x.T @ dz_rows
            grad["b" + d] = dz_rows.sum(axis=0)
        return grad

    def fit(self, pages, epochs=EPOCHS, batch=BATCH, rate=RATE, seed=11):
        """Adam over (features, labels) of pages."""
        import numpy as np

        random = np.random.default_rng(seed)
        m, v, step = {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0
        for epoch in range(epochs):
            order = random.permutation(len(pages))
            for k in range(0, len(order), batch):
                part = [pages[j] for j in order[k:k + batch]]
                grad = self.gradients(np.concatenate([p[0] for p in part]), np.array([len(p[1]) for p in part]), np.concatenate([p[1] for p in part]))
                step += 1
                now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
                for name, g in grad.items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    self.w[name] = (self.w[name] - now * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype("f4")
        return self


#: Names of page parts for the designed pages: (tag, classes).
MAIN_PARTS = [("article", ""), ("main", ""), ("article", "post entry"), ("div", "article body"), ("div", "content main"), ("div", "post content"), ("section", "story text"), ("div", "entry content"), ("main", "page content")]
OTHER_PARTS = {
    "menu": [("nav", ""), ("div", "menu"), ("ul", "nav navigation"), ("div", "breadcrumb"), ("nav", "main menu"), ("div", "tabs"), ("div", "pagination")],
    "header": [("header", ""), ("div", "header"), ("div", "site header top"), ("div", "masthead logo")],
    "footer": [("footer", ""), ("div", "footer"), ("div", "site footer copyright"), ("div", "legal imprint")],
    "sidebar": [("aside", ""), ("div", "sidebar"), ("aside", "widget related"), ("div", "related recommended"), ("div", "side column"), ("section", "popular trending")],
    "notice": [("div", "notice"), ("div", "cookie consent banner"), ("div", "alert message"), ("div", "popup modal"), ("div", "newsletter subscribe"), ("div", "paywall"), ("noscript", ""), ("dialog", "")],
    "advert": [("div", "ad"), ("div", "ads"), ("div", "advert advertisement"), ("div", "sponsor sponsored"), ("aside", "promo"), ("ins", "adsbygoogle"), ("div", "banner ad")],
    "form": [("form", ""), ("form", "search"), ("form", "login signup"), ("div", "form contact"), ("button", ""), ("textarea", ""), ("select", ""), ("label", "")],
    "comments": [("section", "comments"), ("div", "comment list"), ("ol", "comments replies"), ("div", "disqus thread"), ("div", "reader comments discussion"), ("div", "responses")],
    "share": [("div", "share social"), ("ul", "share buttons"), ("div", "author bio meta"), ("div", "tags")],
}
HTML_PARTS = [("html",), ("body",)]


def design(random, sentences):
    """A designed page: [(block, label)] with main text amid other parts under random names."""
    pick = lambda items: items[random.integers(len(items))]
    part = lambda tag, names: (tag, *("." + w for w in names.split()))
    wrap = [part("div", pick(["wrapper", "container", "page", "row", ""]))] if random.random() < 0.5 else []
    page = []

    def text(long):
        return " ".join(pick(sentences) for _ in range(random.integers(1, 5))) if long else " ".join(pick(sentences).split()[:random.integers(1, 6)])

    def other(base, kind=None):
        kind = kind or pick(list(OTHER_PARTS))
        place = [*base, part(*pick(OTHER_PARTS[kind]))]
        inner = pick([[("ul",), ("li",)], [("div",)], [("p",)], []])
        for _ in range(random.integers(1, 8)):
            long = random.random() < (0.7 if kind in ("comments", "sidebar", "notice") else 0.25)
            page.append(((text(long), tuple(place + inner), float(kind == "menu" or random.random() < 0.3)), 0))

    base = [*HTML_PARTS, *wrap]
    for kind in ("header", "menu", "notice", "advert"):
        if random.random() < 0.6:
            other(base, kind)
    main = [*base, part(*pick(MAIN_PARTS))]
    for k in range(random.integers(1, 14)):
        inside = [("h1",)] if k == 0 and random.random() < 0.8 else pick([[("p",)], [("p",)], [("p",)], [], [("h2",)], [("ul",), ("li",)], [("blockquote",), ("p",)], [("div",), ("p",)], [("table",), ("tr",), ("td",)]])
        page.append(((text(inside != [("h1",)] and random.random() < 0.8), tuple(main + inside), float(random.random() < 0.05)), 1))
        if random.random() < 0.12:
            other(main, pick(["advert", "share", "notice", "sidebar", "form", "comments"]))
    for kind in ("share", "comments", "sidebar", "form", "advert", "footer"):
        if random.random() < 0.5:
            other(pick([base, main]) if kind in ("comments", "share") else base, kind)
    return page


def silver(page):
    """[(block, label)] of a page whose markup names its article; None for other pages."""
    named = {w for parts in OTHER_PARTS.values() for tag, names in parts for w in [*("." + n for n in names.split()), *([tag] if tag in ("nav", "header", "footer", "aside", "form", "noscript", "dialog", "ins", "button", "textarea", "select") else [])]}
    out = []
    for block in page:
        tags = [e[0] for e in block[1]]
        inside = next((k for k, t in enumerate(tags) if t in ("article", "main")), None)
        out.append((block, int(inside is not None and not any(w in named for e in block[1][inside + 1:] for w in e))))
    return out if any(label for _, label in out) else None


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES, designed: int = DESIGNED_PAGES) -> Labeller:
    """Fit on at most ``fit_pages`` pages, the first by the hash of their ids, and on designed pages with their words."""
    import numpy as np

    def sample(batches):
        import numpy as np
        import pyarrow as pa

        features = Features()
        for batch in batches:
            out = []
            for page in map(leaves, (x.decode() for x in text_bytes(batch.column(0)))):
                if 0 < len(page) <= FIT_BLOCKS:
                    sentences = [s.strip() + "." for t, _, _ in page for s in t.split(". ")[:3] if s.strip()]
                    labels = [y for _, y in silver(page) or []]
                    out.append((features.of(page).astype("<f4").tobytes(), np.array(labels, "<f4").tobytes(),
                                [s for s in sentences if len(s) <= FIT_SENTENCE][:FIT_SENTENCES]))
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.list_(pa.string()))],
                ["features", "labels", "sentences"])

    small = F.regexp_count(F.col("html").cast("string"), F.lit("<")) <= 4 * FIT_BLOCKS  # passes over pages that cannot be short, cheaply
    keys = pages.filter(F.col("page_id").isNotNull() & small).select("page_id", F.xxhash64("page_id").alias("_h")).distinct()
    keys = keys.orderBy("_h", "page_id").limit(fit_pages)
    chosen = pages.select("page_id", F.col("html").cast("string").alias("html")).join(F.broadcast(keys.select(F.col("page_id").alias("_id"))), F.col("page_id") == F.col("_id"))
    rows = chosen.select("html").dropDuplicates().limit(fit_pages).mapInArrow(sample, "features binary, labels binary, sentences array<string>").collect()
    rows = sorted(rows, key=lambda r: (bytes(r["features"]), r["sentences"]))  # at most fit_pages pages of FIT_BLOCKS blocks
    sentences = sorted({s for r in rows for s in r["sentences"]}) or ["Some words of text."]
    width = PATH_SIZE + WORD_SIZE + MEASURES
    data = [(np.frombuffer(r["features"], "<f4").reshape(-1, width), np.frombuffer(r["labels"], "<f4")) for r in rows if r["labels"]]
    random, features = np.random.default_rng(3), Features()
    for page in (design(random, sentences) for _ in range(designed)):
        data.append((features.of([b for b, _ in page]), np.array([y for _, y in page], "f4")))
    return Labeller().fit(data)


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text, n_chars per page: the texts of its main blocks, joined by spaces."""
    held = pages.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def label(batches):
        import numpy as np
        import pyarrow as pa

        features, labeller = Features(), held.value

        def texts(group):
            sizes = np.array([len(p) for p in group])
            some = sizes > 0
            out = [""] * len(group)
            if some.any():
                if len(group) == 1:
                    main = labeller.long_scores(features, group[0]) > 0
                else:
                    main = labeller.scores(features.of([b for p in group for b in p]), sizes[some]) > 0
                at = 0
                for k, page in enumerate(group):
                    out[k] = " ".join(b[0] for b, m in zip(page, main[at:at + len(page)]) if m)
                    at += len(page)
            return out

        for batch in batches:
            found, group, held_blocks = [], [], 0
            for page in text_bytes(batch.column(2)):
                blocks = leaves(page.decode())
                if group and held_blocks + len(blocks) > LABEL_BLOCKS:
                    found += texts(group)
                    group, held_blocks = [], 0
                group.append(blocks)
                held_blocks += len(blocks)
            found += texts(group)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(label, "page_id long, url string, text string, n_chars long")


def main_texts(pages: DataFrame) -> DataFrame:
    return extract(pages, fit(pages))
