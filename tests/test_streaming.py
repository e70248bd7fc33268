"""Streams against their table form and against a sequential reading of the updates."""
from pyspark.sql import functions as F

from siftline import views as V
from siftline.operators import enrich
from siftline.plans import stream_queries as Q
from siftline.streaming import live, runs, trends


def test_session_debounce_equals_the_table_form(spark, folder):
    updates = V.code_updates(spark, folder)
    table = live.debounce(updates).collect()
    stream = live.debounce_stream(V.code_updates_from(runs.table_stream(spark, folder, "conversations")))
    got = {(r.client_id, r.file_path, r.seq) for r in runs.drain(stream, "debounce").collect()}
    # a session is final once the watermark, ten minutes behind the newest update, has passed it
    watermark = updates.agg(F.max("ts_ms")).first()[0] - 600_000
    assert got == {(r.client_id, r.file_path, r.seq) for r in table if r.ts_ms + live.DEBOUNCE_MS <= watermark}
    assert got


def test_live_stream_equals_a_sequential_reading(spark, folder):
    stream = live.live_scan(Q.live_versions(Q.code_files_stream(spark, folder)), expire=False)
    got = {(r.client_id, r.file_path, r.seq): (r.cached, r.incremental, r.changed_lines, sorted((f.line, f.rule_id) for f in r.findings))
           for r in runs.drain(stream, "live").collect()}
    versions = Q.live_versions(V.code_files(spark, folder)).withColumn("findings", live.rule_matches("code", "language"))
    want, states = {}, {}
    for r in sorted(versions.collect(), key=lambda r: r.seq):
        key = (r.client_id, r.file_path)
        found = [{"line": f.line, "rule_id": f.rule_id} for f in r.findings]
        states[key], cached, incremental, changed, shown = live.step(states.get(key), r.code, found)
        want[*key, r.seq] = (cached, incremental, changed, sorted((f["line"], f["rule_id"]) for f in shown))
    assert got == want
    table = {(r.client_id, r.file_path, r.seq): (False, r.incremental, r.changed_lines, sorted((f.line, f.rule_id) for f in r.findings))
             for r in live.incremental_results(Q.live_versions(V.code_files(spark, folder))).collect()}
    assert table == {k: v for k, v in want.items() if not v[0]}


def test_changed_lines():
    assert live.changed_line_numbers("", "a") == [1]
    assert live.changed_line_numbers("a\nb\nc", "a\nx\nc\nd") == [2, 4]
    assert live.changed_line_numbers("a\nb", "a") == []
    assert live.changed_line_numbers("a", "a\n++b\nc") == [2, 3]


def test_tumbling_stream_is_part_of_the_table_form(spark, folder):
    stream = trends.tumbling_trend(V.detections_from(runs.table_stream(spark, folder, "events")))
    got = {(r.window_start, r.total) for r in runs.drain(stream, "trend").collect()}
    want = {(r.window_start, r.total) for r in trends.tumbling_trend(V.detections(spark, folder)).collect()}
    assert got <= want and len(got) >= len(want) - 2


def test_retrain_is_due_once_per_fifty():
    assert [trends.retrain_due(a, b) for a, b in [(0, 49), (49, 50), (50, 99), (49, 151)]] == [False, True, False, True]


def test_model_answers(spark):
    rows = [('```json\n{"fix_recommendation": "a"}\n```',), ('{"fix_recommendation": "b"}',), ('see {"fix_recommendation": "c"} ok',), ("[1]",), ("{bad",), (None,)]
    df = spark.createDataFrame(rows, "a string")
    got = [r[0] for r in df.select(enrich.parse_answer(F.col("a"))["fix_recommendation"]).collect()]
    assert got == ["a", "b", "c", None, None, None]


def test_failing_client_gives_null(spark):
    def load():
        def call(prompt):
            if "bad" in prompt:
                raise ValueError("no")
            return prompt.upper()
        return call

    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "id long, prompt string")
    got = {r.id: (r.answer, r.error) for r in enrich.ask(df, load).collect()}
    assert got[1] == ("OK", None) and got[2][0] is None and got[2][1]


def test_tables_that_are_folders_stream_like_files(spark, folder, tmp_path):
    from siftline.plans.stream_queries import stream_feedback, stream_parse

    for name in ("conversations", "events"):
        spark.read.parquet(f"{folder}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{folder}/region.parquet").write.parquet(f"{tmp_path}/conversations-old.parquet")
    for build in (stream_parse, stream_feedback):
        want = sorted(build(spark, folder).collect(), key=repr)
        assert want and sorted(build(spark, str(tmp_path)).collect(), key=repr) == want


def test_retraining_is_counted_on_after_a_restart(spark, tmp_path):
    schema = "vulnerability_type string, was_correct boolean"
    calls = []
    for part, n in enumerate((40, 30, 20)):
        spark.createDataFrame([("a", True)] * n, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        trends.feedback_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state", calls.append).awaitTermination()
    assert calls == [70]


def test_records_are_kept_once_over_restarts_and_repeated_epochs(spark, tmp_path):
    schema = "client_id string, file_path string, language string, seq long, code string"
    risky = "result = eval(text)\n"
    batches = [[("c", "a.py", "python", 0, "x = 1")], [("c", "a.py", "python", 1, risky + "x = 1"), ("c", "b.py", "python", 0, risky)], [("c", "a.py", "python", 2, risky + "x = 1")]]
    path, state = f"{tmp_path}/records", f"{tmp_path}/state"
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        records = live.scan_records(live.live_scan(stream, expire=False))
        runs.keep_epochs(records, path, state).awaitTermination()  # a new query on the same state, as after a restart
    kept = runs.kept_epochs(spark, path, records.schema)
    got = {(r.file_path, r.seq): (r.incremental, r.summary.total, [v.line_start for v in r.vulnerabilities]) for r in kept.collect()}
    assert kept.count() == len(got) == 4
    assert got["a.py", 0] == (False, 0, []) and got["a.py", 1][0] and got["a.py", 1][2] and set(got["a.py", 1][2]) == {1}
    assert not got["b.py", 0][0] and got["b.py", 0][1] == got["a.py", 1][1]
    # the epoch of the last batch written again replaces itself
    last = kept.agg(F.max("epoch")).first()[0]
    rows = kept.filter(F.col("epoch") == last).drop("epoch").collect()
    spark.createDataFrame(rows, records.schema).write.mode("overwrite").parquet(f"{path}/epoch={last}")
    assert runs.kept_epochs(spark, path, records.schema).count() == 4


def test_late_rows_are_counted(spark, tmp_path):
    from datetime import datetime, timedelta

    base = datetime(2024, 1, 1)
    schema = "detected_at timestamp_ntz, severity string, confidence_score double"
    for hours in ([1, 2, 60], [61], [3, 62, 100]):  # the third hour comes a batch after the watermark has passed its day
        rows = [(base + timedelta(hours=h), "high", 0.5) for h in hours]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    import glob
    import os

    for k, name in enumerate(sorted(glob.glob(f"{tmp_path}/in/*.parquet"), key=os.path.getmtime)):
        os.utime(name, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    rows, late = runs.drained(trends.tumbling_trend(stream), "late")
    assert late == 1
    assert {(r.window_start, r.total) for r in rows.collect()} == {(base, 2), (base + timedelta(days=2), 3)}


def test_rules_of_a_stream_are_matched_behind_the_shuffle_of_its_state(spark, tmp_path):
    """One source file is one task; its updates are spread before their texts are scanned, and by the one shuffle of the state."""
    schema = "client_id string, file_path string, language string, seq long, code string"
    rows = [("c", f"f{k}.py", "python", s, f"a = {k}\n" * s + "eval(x)") for k in range(30) for s in (1, 0, 2)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = live.live_scan(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), expire=False)
    plan = stream._jdf.queryExecution().analyzed().toString()
    dealt, matched, kept = (plan.index(p) for p in ("RepartitionByExpression", "RLIKE", "FlatMapGroupsInPandasWithState"))
    assert kept < matched < dealt  # a plan is printed from its result down
    got = {(r.file_path, r.seq): (r.cached, r.incremental, r.changed_lines, {f.line for f in r.findings}) for r in runs.drain(stream, "live").collect()}
    assert len(got) == 90
    assert got["f7.py", 0] == (False, False, 1, {1}) and got["f7.py", 1] == got["f7.py", 2] == (False, True, 1, set())
