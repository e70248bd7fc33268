import struct
import zlib

import pytest

import corpus_pipeline
from siftline.llm import decontaminate, language_id, ngram_join, packed_ids, queries, source_mix


def test_stages_and_result(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, folder)
        assert left.columns == columns, name
        left = spark.createDataFrame(left.collect(), docs.schema)
    rows = sorted(left.collect(), key=lambda r: r["doc_id"])
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain, start, want = Tokenizer.from_file(public.path("word_bpe_49k.json")), 0, []
    for r in rows:
        ids = plain.encode(r["text"], add_special_tokens=False).ids + [packed_ids.END_ID]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want
    # the decisions of each stage took effect
    found = {r["doc_id"] for r in rows}
    leaked = {r["doc_id"] for r in decontaminate.leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    copies = {r["doc_id"] for r in ngram_join.near_duplicates(docs).collect() if r["doc_id"] != r["component_id"]}
    assert found and not found & leaked and not found & copies


@pytest.mark.parametrize("name", sorted(queries.CHECK_SQL))
def test_query_matches_its_sql(spark, folder, name):
    from siftline.checks import compare

    ok, _, message = compare(spark, folder, queries.QUERIES[name], queries.CHECK_SQL[name])
    assert ok, message
