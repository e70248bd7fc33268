"""Tables and documents that can be written again, and models that are asked once."""
from datetime import datetime

from pyspark.sql import functions as F

from siftline.operators import enrich, findings, similarity
from siftline.sources import stored

FOUND = "file_path string, line_start int, line_end int, name string, severity string, confidence double, code_snippet string, ai_explanation string"


def test_findings_are_appended_once(spark, tmp_path):
    path, day = f"{tmp_path}/found", F.lit("2024-05-01").cast("date")
    first = spark.createDataFrame([("a", 1, 1, "x", "high", 0.5, None, None), ("a", 1, 1, "x", "high", 0.5, None, None), ("b", 2, 3, "y", "low", 0.1, "s", "t")], FOUND)
    more = first.unionByName(spark.createDataFrame([("c", 9, 9, "x", None, None, None, None)], FOUND))
    assert findings.read_findings(spark, path).count() == 0
    for frame, after in ((first, 2), (first, 2), (more, 3), (more.limit(0), 3)):
        findings.append_findings(frame, path, day)
        assert findings.read_findings(spark, path).count() == after
    rows = {r.file_path: r for r in findings.read_findings(spark, path).collect()}
    assert rows["a"].code_snippet == "" and rows["b"].ai_explanation == "t" and str(rows["c"].day) == "2024-05-01"


def test_the_last_finished_version_counts(spark, tmp_path):
    path = f"{tmp_path}/documents"
    assert stored.load_documents(spark, path).count() == 0
    for n in range(2):
        assert stored.save_documents(spark.createDataFrame([(f'{{"a": {{"correct": {n}, "total": 5}}}}',)], "document string"), path) == n
    (tmp_path / "documents" / "version=7").mkdir()  # a write that never ended leaves no marker
    back = stored.history_from_document(stored.load_documents(spark, path)).collect()
    assert [tuple(r) for r in back] == [("a", 1, 5)]


def test_history_goes_there_and_back(spark):
    rows = [("XSS", 3, 4), ("é \"quoted\"", 0, 2), ("none", None, 1)]
    df = spark.createDataFrame(rows, "vulnerability_type string, correct long, total long")
    got = stored.history_from_document(stored.history_document(df)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)


def test_scans_are_named_by_their_request(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "full", "a"), (1, "quick", "a"), (2, None, "a")], "project_id long, scan_type string, seq string")
    made = findings.create_scans(df, F.lit(datetime(2024, 1, 1)))
    assert made.count() == 3 and {r.scan_type for r in made.collect()} == {"full", "quick"}


def test_failed_answers_are_asked_again_and_given_ones_are_not(spark, tmp_path):
    path, calls = f"{tmp_path}/answers", f"{tmp_path}/calls"
    rows = [("code one", "XSS", 1, "high", "python"), ("code one", "XSS", 1, "high", "python"), ("bad code", "XSS", 2, "low", "python")]
    found = spark.createDataFrame(rows, "code_snippet string, name string, line_start int, severity string, language string")

    def client(broken):
        def load():
            def call(prompt):
                with open(calls, "a") as log:
                    log.write("bad\n" if "bad code" in prompt else "one\n")
                if broken and "bad code" in prompt:
                    raise ValueError("no")
                return '{"fix_recommendation": "mend"}'
            return call
        return load

    now = F.lit(datetime(2024, 1, 2)).cast("timestamp_ntz")
    shown = enrich.ask_through_cache(found, path, client(True), now).collect()
    assert sorted(r.from_cache for r in shown) == [False, True, True]
    shown = enrich.ask_through_cache(found, path, client(False), now).collect()
    assert all(r.from_cache and r.explanation.fix_recommendation == "mend" for r in shown)
    enrich.ask_through_cache(found, path, client(False), now).collect()
    assert sorted(open(calls).read().split()) == ["bad", "bad", "one"]
    # a day later all are asked again
    enrich.ask_through_cache(found, path, client(False), F.lit(datetime(2024, 1, 4)).cast("timestamp_ntz")).collect()
    assert len(open(calls).read().split()) == 5


def test_embeddings_come_from_the_cache(spark, tmp_path):
    path = f"{tmp_path}/vectors"
    rows = spark.createDataFrame([("k1", "a b a"), ("k1", "a b a"), ("k2", ""), (None, "c")], "code_key string, code string")
    first = similarity.embed_through_cache(rows, path)
    assert first.count() == 4
    by = {r.code_key: r.embedding for r in first.collect()}
    assert sum(by["k1"]) == 3 and max(by["k1"]) == 2 and sum(by["k2"]) == 0 and by[None] is None

    def none():
        raise AssertionError("nothing is left to embed")

    assert similarity.embed_through_cache(rows, path, none).count() == 4 and spark.read.parquet(path).count() == 2
