import re

from siftline.llm import license_index as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}


def plain(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for label, phrase in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def check(df, texts):
    got = {r["doc_id"]: r for r in L.scan(df).collect()}
    for doc, text in texts.items():
        r = got[doc]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(text), text
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    return got


def test_given_documents(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    check(df, {r["doc_id"]: r["text"] for r in df.collect()})


def test_edges(documents):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    texts = [None, "", "MIT License", "mit\x00license mit-license MIT  LICENSE", "GNU Lesser General Public License", "été mit license é", notice,
             notice.replace("obtaining a", "having the"), "permission is hereby", "Apache License " * 3000, "Licensed under CC BY-NC 4.0.", "general public licensed", "mit license" + "x" * 10]
    got = check(documents(list(enumerate(texts))), dict(enumerate(texts)))
    assert got[4]["labels"] == "gpl,lgpl" and got[6]["labels"] == "mit" and got[7]["labels"] == "mit" and got[7]["score"] < 1
    assert got[8]["labels"] == "" and got[10]["labels"] == "cc-by-nc"
    assert L.scan(documents([])).count() == 0
