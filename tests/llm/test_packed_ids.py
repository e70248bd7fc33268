import io
import random
import struct
import zlib

import numpy as np
import pytest

from siftline.llm import packed_ids as P


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 4099, dtype="u8").astype("u4")
    data = P.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert (P.unpack(data, bits, len(ids)) == ids).all()


def test_bits_for_vocabulary():
    assert [P.bits_for(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


def test_shard_random_access():
    rng = np.random.default_rng(0)
    ids = [rng.integers(0, 50_000, n, dtype="u4") for n in (0, 5, 200_000, 1, 70_000)]
    buffer = io.BytesIO()
    writer = P.ShardWriter(buffer, 50_001)
    for k, x in enumerate(ids):
        writer.add(None if k == 1 else k, x.tobytes())
    writer.close()
    reader = P.ShardReader(io.BytesIO(buffer.getvalue()), len(buffer.getvalue()))
    docs, counts = reader.documents()
    assert docs == [0, None, 2, 3, 4] and counts.tolist() == [len(x) for x in ids]
    whole = np.concatenate(ids)
    for start, count in ((0, 10), (65_530, 20), (131_000, 100_000), (len(whole) - 3, 50)):
        assert (reader.ids(start, count) == whole[start:start + count]).all()


def test_words_give_the_ids_of_the_whole_text(tokenizer, spark, folder):
    path, plain = tokenizer
    random.seed(1)
    given = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    odd = ["", "It's   don't x y\x1cz <|endoftext|>, <|EndOfText|> W̊ İ Á éa, 12.5% ***,. (ab)", "x" * 3000, "a\u0085b\n\tc"]
    odd += ["".join(random.choices("aB ̊́,.'sTé 　<|1%\n", k=80)) for _ in range(300)]
    encoder = P.Encoder(path)
    for text in given + odd:
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_against_plain_encoding(tokenizer, spark, documents):
    path, plain = tokenizer
    rows = [(5, "Some text, twice."), (5, "Some text, twice."), (None, "no id"), (3, None), (9, ""), (-2, "é" * 50), (7, "long words " * 5000)]
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in P.packed_tokens(documents(rows)).collect())
    start = 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for have, (doc, text) in zip(got, ordered, strict=True):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [P.END_ID]
        assert have == (start, doc, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_empty_table(documents):
    assert P.packed_tokens(documents([])).count() == 0
