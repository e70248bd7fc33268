"""A training corpus from the table ``documents`` in five stages, each written as Parquet and read by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of their input.
"""
from siftline.llm import decontaminate, language_id, ngram_join, packed_ids, source_mix
from siftline.llm.common import read_table, stored

#: SQL cannot state language scores or tokenizer ids; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def known_language(spark, docs, sf_dir):
    """Drops documents whose language cannot be determined (no text or no letter)."""
    return language_id.accepted(docs)


def near_duplicates(spark, docs, sf_dir):
    """Keeps one document, the one with the smallest id, of each group of near duplicates."""
    return ngram_join.without_near_duplicates(docs)


def decontamination(spark, docs, sf_dir):
    """Drops documents that hold a benchmark item."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def source_weights(spark, docs, sf_dir):
    """Takes each document as often as its source's target asks for; a row per time."""
    return source_mix.mixed(docs)


def token_ids(spark, docs, sf_dir):
    """Writes packed token ids and reads them back: doc_id, start, n_tokens, ids_crc32."""
    return packed_ids.packed_tokens(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", source_weights),
    ("token_ids", token_ids),
]


def run(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}-{name}")
    return docs
