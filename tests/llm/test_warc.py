import gzip
import hashlib
import base64
import io

from pyspark.sql import functions as F

from siftline.llm import warc as W
from siftline.session import new_run_folder

SCHEMA = "page_id long, url string, html string, record_type string, row_id int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


ROWS = [(1, "http://a/1", "same"), (7, "http://a/7", "same"), (3, None, "same"), (4, "http://b\r\n/ x", "é\U0001F600" * 9000), (5, "u", None), (6, "u", ""),
        (None, "n", "same"), (8, "r", "twice"), (8, "r", "twice"), (9, "z", "\r\n\r\n<p>WARC/1.1\r\n\r\n")]


def test_round_trip(spark):
    got = W.archived(pages(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r["page_id"] is not None:
            payload = (next(t for p, _, t in ROWS if p == r["page_id"]) or "").encode()
            assert r["payload_bytes"] == len(payload)
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"]))
    assert by[7] == [("response", None)] and by[1] == by[3] == by[None] == [("revisit", 7)]
    assert by[6] == [("response", None)] and by[5] == [("revisit", 6)]
    assert sorted(by[8], key=repr) == [("response", None), ("revisit", 8)]


def test_small_payloads_are_all_responses(spark):
    got = W.archived(pages(spark, ROWS), min_bytes=5)
    assert {r["page_id"] for r in got.filter("record_type = 'revisit'").collect()} == {8}


def test_predicates_and_payloads(spark):
    folder = new_run_folder(spark, "warc-test")
    W.write_archives(pages(spark, ROWS), folder)
    full = W.read_archives(spark, folder)
    one = W.read_archives(spark, folder, "full", "record_type = 'response'", F.col("page_id") == 4)
    assert {r["page_id"]: r["payload"].decode() for r in one.collect()} == {4: ROWS[3][2]}
    none = W.read_archives(spark, folder, "none", F.col("record_type").isin("revisit") & (F.col("page_id") < 8)).collect()
    assert {r["page_id"] for r in none} == {1, 3, 5} and all(r["payload"] is None for r in none)
    uri = {r["page_id"]: r["target_uri"] for r in full.collect()}
    assert uri[3] is None and uri[4] == "http://b%0D%0A/%20x"
    plan = full.filter("record_type = 'response' and refers_to is null").select("page_id")
    assert plan.count() == 5


def test_predicates_reach_the_reader(spark, capsys):
    folder = new_run_folder(spark, "warc-test")
    W.write_archives(pages(spark, ROWS), folder)
    W.read_archives(spark, folder, "none", "record_type = 'revisit'").explain()
    assert "Filter" not in capsys.readouterr().out.replace("RuntimeFilters", "")  # Spark applies what the reader leaves
    W.read_archives(spark, folder, "none").filter("record_type = 'revisit'").explain()
    plan = capsys.readouterr().out
    assert plan.index("Filter") < plan.index("Sample")


def test_a_frame_can_be_used_many_times(spark):
    folder = new_run_folder(spark, "warc-test")
    W.write_archives(pages(spark, ROWS), folder)
    found = W.read_archives(spark, folder, "none")
    few = W.read_archives(spark, folder, "none", "page_id < 8")
    for df, low, high in ((found, 4, 3), (few, 4, 1)):
        total = df.count()
        assert df.filter("page_id = 4").count() == 1
        assert df.count() == total
        assert df.filter("page_id < 5").unionByName(df.filter("page_id > 6")).count() == 3 + sum(p > 6 for p, *_ in df.select("page_id").collect() if p is not None)
        both = df.filter("record_type = 'response'").alias("a").join(df.filter("record_type = 'revisit'").alias("b"), F.expr("b.refers_to = a.page_id"))
        assert sorted(r[0] for r in both.select("b.page_id").collect() if r[0] is not None) == [p for p in (1, 3, 5, 8) if p < 8 or df is found]


def test_responses_and_revisits_of_one_result(spark):
    got = W.archived(pages(spark, ROWS))
    kinds = got.filter("record_type = 'response'").unionByName(got.filter("record_type = 'revisit'"))
    assert kinds.count() == len(ROWS) == got.count()
    assert {r["record_type"]: r["count"] for r in kinds.groupBy("record_type").count().collect()} == {"response": 5, "revisit": 5}


def test_other_writers(spark):
    records = [W.build_record(k, f"http://x/{k}", "response", None, 0, b"payload %d " % k * 2000) for k in range(5)]
    reader = W.WarcReader("/", "full")
    for data in (b"".join(records), b"".join(gzip.compress(r) for r in records), b"".join(map(W.gzip_member, records))):
        assert [v["payload"] for v in reader.records(io.BytesIO(data), len(data))] == [b"payload %d " % k * 2000 for k in range(5)]
    assert gzip.decompress(b"".join(map(W.gzip_member, records))) == b"".join(records)


def test_unwanted_payloads_are_not_inflated():
    records = [W.gzip_member(W.build_record(k, "u", "response", None, 0, bytes(range(256)) * 4000)) for k in range(3)]
    broken = [r[:len(r) // 2] + bytes(len(r) - len(r) // 2) for r in records]
    data = b"".join(broken)
    assert [v["page_id"] for v in W.WarcReader("/", "none").records(io.BytesIO(data), len(data))] == [0, 1, 2]


def test_empty_table(spark):
    assert W.archived(pages(spark, ROWS).limit(0)).count() == 0


def test_hadoop_names_of_stores():
    from siftline.llm.common import file_system

    system, path = file_system("file:///tmp/x")
    assert path == "/tmp/x" and file_system("/tmp/x")[1] == "/tmp/x"
