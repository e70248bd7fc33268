import math
import random
import re
from collections import Counter

from siftline.llm import decontaminate as D

TOKEN = re.compile(r"[^\W_]+")


def shingled(words, width):
    return [tuple(words[k:k + width]) for k in range(len(words) - width + 1)]


def plain(documents, items):
    """All windows of every item's size, weighted Jaccard in plain Python."""
    split = {k: TOKEN.findall((t or "").lower()) for k, t in items}
    split = {k: w for k, w in split.items() if w}
    width = {k: min(5, len(w)) for k, w in split.items()}
    df = Counter(s for k, w in split.items() for s in set(shingled(w, width[k])))
    weight = lambda s: math.log1p(len(split) / max(1, df[s]))
    out = {}
    for doc, text in documents:
        words = TOKEN.findall((text or "").lower())
        for k, item in split.items():
            own = Counter(shingled(item, width[k]))
            for start in range(max(1, len(words) - len(item) + 1)):
                seen = Counter(shingled(words[start:start + len(item)], width[k]))
                if not (seen & own):
                    continue
                most = sum(n * weight(s) for s, n in (seen | own).items())
                similarity = round(sum(n * weight(s) for s, n in (seen & own).items()) / most, 6)
                if similarity >= 0.8:
                    out[doc, k] = max(out.get((doc, k), 0), similarity)
    return out


def test_against_all_windows(spark, documents):
    random.seed(4)
    words = lambda n: [f"w{random.randrange(3000)}" for _ in range(n)]
    items = [(k, " ".join(words(random.randrange(10, 60)))) for k in range(25)] + [(90, None), (91, "..."), (92, "short item")]
    rows = []
    for k in range(60):
        item = items[k % 25][1].split()
        if k % 3 == 1:
            item[random.randrange(len(item))] = "changed"
        if k % 3 == 2:
            item = item[:len(item) // 2]
        rows.append((k, " ".join(words(random.randrange(40)) + [w.upper() + "," for w in item] + words(random.randrange(40)))))
    rows += [(60, None), (61, ""), (62, items[0][1]), (62, items[0][1]), (63, "a Short, ITEM here"), (64, items[1][1] + " " + items[2][1]), (65, "clean " * 30_000)]
    benchmark = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, n_words string")
    df = documents(rows)
    got = D.leaks(df, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in got} == plain(rows, items)
    assert sum(r["doc_id"] == 62 for r in got) == 2
    clean = D.without_leaks(df, benchmark)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == {d for d, _ in rows} - {d for d, _ in plain(rows, items)}


def test_items_that_share_a_long_template(spark, documents):
    random.seed(6)
    template = [f"t{k}" for k in range(154)]
    items = [(k, " ".join(template + [f"i{k}x{j}" for j in range(5)])) for k in range(200)]
    rows = [(k, " ".join(items[k][1].split()[:-2] + [f"other{k}", f"more{k}"])) for k in range(40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.leaks(documents(rows), benchmark).collect()}
    assert set(got) == {(k, k) for k in range(40)}
    assert got == plain(rows, items)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert D.leaks(documents([(1, "a b c d e f g")]), none).count() == 0
    assert D.leaks(documents([]), one).count() == 0
    assert D.leaks(documents([(1, "a b c d e f g")]), one).count() == 1


def test_clean_rows_stay_under_null_and_repeated_ids(spark, documents):
    leak, clean = "x one two three four five six seven y", "quite another text of the same id here"
    benchmark = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    left = D.without_leaks(documents([(None, leak), (None, clean), (None, None), (5, clean), (5, leak), (6, leak)]), benchmark)
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([(None, clean), (None, None), (5, clean)], key=repr)


def random_shingles(random, words, uneven):
    """Rows (shingle, n, weight) of an item, weights even or over three powers of ten."""
    return [(random.getrandbits(63), 1, 10.0 ** random.uniform(-1.5, 1.5) if uneven else 1.0) for _ in range(max(1, words - 4))]


def changed(random, rows, similarity):
    """Rows whose weighted Jaccard similarity to the given ones is just over the wanted one."""
    order, total, gone = rows[:], sum(w for *_, w in rows), 0.0
    random.shuffle(order)
    kept = []
    for row in order:
        # a row gone counts once on either side
        if (total - gone - row[2]) / (total + gone + row[2]) >= similarity:
            gone += row[2]
            kept.append((random.getrandbits(63), 1, row[2]))
        else:
            kept.append(row)
    return kept


def test_pairs_at_the_threshold_meet(spark):
    random.seed(9)
    items, windows = [], []
    for k in range(600):
        words = random.randrange(20, 150)
        rows = random_shingles(random, words, k % 2)
        items += [(k, words, *r) for r in rows]
        windows += [(k, words, *r) for r in changed(random, rows, 0.8)]
    schema = "long, n_words int, shingle long, n long, weight double"
    found = D.candidates(spark.createDataFrame(windows, "content " + schema), spark.createDataFrame(items, "item_id " + schema))
    met = {(r["content"], r["item_id"]) for r in found.collect()}
    assert sum((k, k) in met for k in range(600)) >= 0.998 * 600
    # and unrelated pairs seldom pass the distance
    assert len(met) <= 620


def test_few_of_all_items_meet_a_window(spark):
    random.seed(10)
    schema = "long, n_words int, shingle long, n long, weight double"
    items = [(k, words, *r) for k in range(2000) for words in [random.randrange(20, 150)] for r in random_shingles(random, words, False)]
    windows = [(k, words, *r) for k in range(200) for words in [random.randrange(20, 150)] for r in random_shingles(random, words, False)]
    filed = D._fingerprints(spark.createDataFrame(items, "item_id " + schema), "item_id", "n_words").select("item_id", "n_words", D._blocks(D.FILED_BITS))
    asked = D._fingerprints(spark.createDataFrame(windows, "content " + schema), "content", "n_words").select("content", "n_words", D._blocks(D.ASKED_BITS))
    met = asked.join(filed, ["n_words", "block", "value"]).select("content", "item_id").distinct().count()
    assert 0 < met <= 0.002 * 2000 * 200


def test_null_ids(spark, documents):
    item = "one two three four five six seven"
    benchmark = spark.createDataFrame([(1, item), (None, "eight nine ten eleven twelve thirteen")], "item_id long, text string")
    got = D.leaks(documents([(None, "x " + item), (None, "clean words only here and there"), (3, item + " y")]), benchmark)
    assert sorted(((r["doc_id"], r["item_id"]) for r in got.collect()), key=repr) == sorted([(None, 1), (3, 1)], key=repr)


def test_query_sql_with_short_items(spark, tmp_path):
    """The query and its SQL agree on a fixture with items under five words and documents shorter than an item."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from siftline.checks import compare
    from siftline.llm import queries

    random.seed(12)
    words = lambda n: [f"w{random.randrange(400)}" for _ in range(n)]
    items = [(k, " ".join(words(n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 9, 20, 40])]
    docs = [(k, " ".join(words(random.randrange(12)) + items[k % 9][1].split()[:random.choice([3, 30, 99])] + words(random.randrange(12)))) for k in range(120)]
    import duckdb

    for name, rows, ident in (("benchmark", items, "item_id"), ("documents", docs, "doc_id")):
        pq.write_table(pa.table({ident: [r[0] for r in rows], "text": [r[1] for r in rows]}), f"{tmp_path}/{name}.parquet")
    for name in ("region nation customer supplier part orders lineitem events embeddings pages labels conversations").split():
        duckdb.sql(f"COPY (SELECT 1 AS x) TO '{tmp_path}/{name}.parquet'")
    ok, n, message = compare(spark, str(tmp_path), queries.QUERIES["op4_decontaminate"], queries.CHECK_SQL["op4_decontaminate"])
    assert ok and n > 50, message
