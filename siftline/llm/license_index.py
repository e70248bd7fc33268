"""Licence scan with a positional rare-token index.

Templates (a label, its words, the key phrases it must hold) are indexed by word and position.  Document frequencies
of all template words over the whole corpus give each template its rarest words, its anchors.  A file looks up the
anchors it holds; each posting proposes a start of its template, the proposals of a template's anchors are intersected
by relative position, and a start counts if the key phrases stand at their places and enough of the template's words
do.  The base phrases are templates that must match whole, so no place of theirs is missed.

Defined results: a null or empty text has no words, no labels, score 0 and null places; repeated rows get equal
results; overlapping places all count; an empty table gives an empty result; further columns are ignored.
"""
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, text_bytes

#: (label, phrase): must stand whole.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
#: (label, text, key phrases): opening words of well-known public licence notices.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("apache", "licensed under the apache license version 2 0", ["licensed under the apache license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["free software", "gnu general public license"]),
    ("gpl", "licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
]
#: Share of a template's words that must stand at their relative positions.
MIN_MATCH = 0.8
#: Anchors of a template whose proposed starts are intersected.
ANCHORS = 2

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(data: bytes) -> list:
    return _WORD.findall(data.translate(LOWER_ASCII))


class Index:
    """Anchor word -> [(template, position)], templates with their words and key phrase places."""

    def __init__(self, base, templates, frequency):
        self.templates, self.postings = [], {}
        for label, text, keys, need in [(a, b, [b], 1.0) for a, b in base] + [(a, b, c, MIN_MATCH) for a, b, c in templates]:
            words = text.encode().split()
            places = []
            for key in keys:
                key = key.encode().split()
                places += [(i, key) for i in range(len(words)) if words[i:i + len(key)] == key][:1]
            rare = sorted(range(len(words)), key=lambda i: (frequency.get(words[i], 0), i))
            # anchors come from the key phrases, which a match must hold
            inside = [i for i in rare if any(p <= i < p + len(k) for p, k in places)]
            t = len(self.templates)
            self.templates.append((label, words, places, need, inside[:ANCHORS]))
            self.postings.setdefault(words[inside[0]], []).append((t, inside[0]))
        self.n_base = len(base)

    def matches(self, words):
        """{(template, start): share of the template's words in place}."""
        found = {}
        for i, w in enumerate(words):
            if w not in self.postings:
                continue
            for t, p in self.postings[w]:
                label, text, keys, need, anchors = self.templates[t]
                start = i - p
                if any(not 0 <= start + a < len(words) or words[start + a] != text[a] for a in anchors[1:]):
                    continue
                if any(start + at < 0 or words[start + at:start + at + len(key)] != key for at, key in keys):
                    continue
                same = sum(0 <= start + k < len(words) and words[start + k] == x for k, x in enumerate(text)) / len(text)
                if same >= need:
                    found[t, start] = same
        return found


def word_frequencies(documents: DataFrame, base=BASE, templates=TEMPLATES) -> dict:
    """In how many documents each template word occurs; one number per template word reaches the driver."""
    vocabulary = frozenset(w for _, text, *_ in [*base, *templates] for w in text.encode().split())

    def count(batches):
        import collections

        import pyarrow as pa

        seen = collections.Counter()
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                seen.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counted = documents.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}


def scan(documents: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per document."""
    index = Index(base, templates, word_frequencies(documents, base, templates))

    def look(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text in text_bytes(batch.column(1)):
                words = words_of(text)
                found = index.matches(words)
                starts = [start for t, start in found if t < index.n_base]
                own = {index.templates[t][0] for t, _ in found if t < index.n_base}
                every = own | {index.templates[t][0] for t, _ in found}
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None),
                             ",".join(sorted(own)), ",".join(sorted(every)), max(found.values(), default=0.0)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        look, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
