"""Scanning: sources, rules, segments, dedupe and graphs on small literal inputs."""
import re

import pytest
from pyspark.sql import functions as F

from siftline import fixed_values as fixed
from siftline.functions import language as L
from siftline.functions import text as T
from siftline.operators import graph, scan, segments
from siftline.sources import files, rules, stored

PYTHON = 'import os\n\ndef load(uid):\n    # eval(note)\n    sql = "SELECT a FROM t WHERE id = " + uid\r\n    os.system(f"x {uid}")\n    return eval(uid)\n'


def corpus(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "file_id long, file_path string, language string, content string")


def python_rule_hits(code, language):
    """The line scan written with Python's own regexes."""
    found = set()
    for n, line in enumerate(code.split("\n"), 1):
        text = line.strip()
        if not text or (language == "python" and text.startswith("#")) or (
                language in ("javascript", "java", "c", "cpp") and text.startswith("//")):
            continue
        for i, (rule, lang, regex) in enumerate(fixed.RULE_REGEXES):
            if lang == language and re.search(regex, line, re.IGNORECASE | re.MULTILINE):
                found.add((n, rule, i))
    return found


@pytest.mark.parametrize("language,code", [
    ("python", PYTHON),
    ("python", 'x = yaml.load(s\ry = yaml.load(s)\nQUERY = "a" + b\nＥval(x)\nécole.eval (x)\nopen(a + "é")\n'),
    ("javascript", "// eval(x)\nel.innerHTML = x;\ndb.query('a' + b)\nélan = evaluate(x)\n"),
    ("php", "<?php\n# system(x)\necho 'a' . $_GET['b'];\n`ls $x`;\n"),
    ("c", "system(x);\n  // system(y)\npopen (z);\n"),
])
def test_rule_hits_equal_python_regexes(spark, language, code):
    hits = scan.rule_hits(corpus(spark, ("f", language, code)))
    assert {(r.line_no, r.rule_id, r.regex_ord) for r in hits.collect()} == python_rule_hits(code, language)


def test_threshold_and_confidence(spark):
    found = {(r.line_start, r.name): round(r.confidence, 4) for r in scan.rule_findings(corpus(spark, ("a.py", "python", PYTHON))).collect()}
    assert found[5, "SQL Injection"] == 1.0
    assert found[7, "Unsafe eval usage"] == 0.8  # exactly at its threshold
    assert not any(line == 4 for line, _ in found)


def test_empty_file_and_unknown_language(spark):
    df = corpus(spark, ("a.py", "python", ""), ("b.xx", None, "eval(x)"))
    assert scan.rule_findings(df).count() == 0
    assert scan.keyword_findings(df).count() == 0
    assert graph.graph_nodes(df).filter("file_id = 0").count() == 0


def test_invalid_regexes_fall_back(spark):
    usable = rules.usable_rules(spark, [
        ("X", "python", r"os.system\s*((") , ("Y", "python", r"\beval\s*(("), ("Z", "python", "((") , ("W", "python", r"ok\(")])
    assert [(u[0], u[3]) for u in usable] == [("OSYS-001", True), ("EVAL-001", True), ("W", False)]
    df = corpus(spark, ("a.py", "python", "# os.system(x)\neval(y)"))
    assert {(r.finding_id, r.confidence) for r in scan.fallback_findings(df, usable).collect()} == {
        ("OSYS-001-a.py-1", 0.9), ("EVAL-001-a.py-2", 0.9)}


def test_doubled_backslashes_are_normalised():
    assert rules.normalise_regex(r"os\.system\s*\\(") == r"os\.system\s*\("
    assert all(rules.normalise_regex(r) == r for _, _, r in fixed.RULE_REGEXES)


def test_first_wins_is_idempotent_and_ordered(spark):
    rows = [("f", 1, "n", a, r, x, 0.5) for a in (1, 0) for r in (2, 1) for x in (3, 0)] + [("f", 1, "m", 9, 9, 9, 0.1)]
    df = spark.createDataFrame(rows, "file_path string, line_start int, name string, analyzer_ord int, rule_ord int, regex_ord int, confidence double")
    once = scan.first_per_place(df)
    assert sorted(tuple(r) for r in once.collect()) == [("f", 1, "m", 9, 9, 9, 0.1), ("f", 1, "n", 0, 1, 0, 0.5)]
    assert sorted(once.collect()) == sorted(scan.first_per_place(once).collect())


def test_blocks_and_multiline_segments(spark):
    code = "x\ndef a():\n  1\n\n  2\n\nstray\ndef b(): pass"
    df = corpus(spark, ("a.py", "python", code))
    blocks = [(r.start_line, r.code) for r in segments.function_blocks(df, "file_id").collect()]
    # the blank third line is too early to end the block, the blank fifth one ends it
    assert blocks == [(2, "def a():\n  1\n\n  2\n"), (8, "def b(): pass")]
    text = "a = 1\nprint(a)\n\neval(x)\nuser\npickle.loads(request)"
    got = [(r.start_line, r.code, r.type) for r in segments.multiline_segments(corpus(spark, ("b", "python", text)), "file_id").collect()]
    want = [
        (text[:m.start()].count("\n") + 1, m.group(0), kind)
        for pattern, kind in fixed.SUSPICIOUS_SEGMENTS for m in re.finditer(pattern, text, re.MULTILINE | re.IGNORECASE)]
    assert got == want and want


def test_languages(spark):
    paths = ["a/B.TSX", "a.tar.h", ".py", "noext", "x/y.hpp"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(L.from_extension(F.col("p"))).collect()] == ["javascript", "c", None, None, "cpp"]


def test_tokens_and_hash_ignore_layout(spark):
    df = spark.createDataFrame([("  É = \"s\"  # c\n\n\tfoo(x)",), ("É = \"s\"  # c\nfoo(x)\r\n",)], "c string")
    rows = df.select(T.code_tokens("c"), T.structure_hash("c")).collect()
    assert rows[0][0] == ["é", "string", "foo", "x"]
    assert rows[0][1] == rows[1][1]


def test_read_tree_skips_other_files_and_bad_bytes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.py").write_bytes(b"eval(x)\xff\n")
    (tmp_path / "b.txt").write_text("eval(x)")
    (tmp_path / "c.hpp").write_text("gets(b);")
    found = files.with_language(files.read_tree(spark, str(tmp_path)))
    got = {r.file_path.rsplit("/", 1)[1]: (r.language, r.content) for r in found.collect()}
    assert got == {"a.py": ("python", "eval(x)\n"), "c.hpp": ("cpp", "gets(b);")}


def test_manifest_files(spark, tmp_path):
    good = tmp_path / "m.xml"
    good.write_text('<all><testcase id="1" cwe="CWE-89" language="c" url="u">text</testcase><testcase id="2" cwe="CWE-7"/></all>')
    assert [tuple(r) for r in stored.read_manifest(spark, str(good)).collect()] == [("1", "CWE-89", "c", "u", "text")]
    page = tmp_path / "page.xml"
    page.write_text("<html><body>none</body></html>")
    assert stored.read_manifest(spark, str(page)).count() == 0


def test_rule_store_is_replaced(spark, tmp_path):
    path = str(tmp_path / "kb")
    for _ in range(2):
        rules.save_rules(rules.rule_table(spark), path)
    assert spark.read.parquet(path).count() == 8
    assert rules.search_rules(rules.rule_table(spark), language="c").count() == 1


def test_required_text_is_in_every_match():
    for regex in ["a|b", "ab?c", "(a(b)c)?d", "x{2}y", "a.b", "ab*"]:
        assert rules.required_text(regex) == ""
    assert rules.required_text(r"os\.system\s*\([^)]*\+") == "os.system"
    assert rules.required_text(r"`[^`]*\$") in "`$"
    assert all(rules.required_text(r) for _, _, r in fixed.RULE_REGEXES)


def test_case_folding_of_special_letters(spark):
    df = corpus(spark, ("a.php", "php", "ſystem(x)\nEXEC(y)\nprınt $_GET"))
    assert {(r.line_no, r.rule_id, r.regex_ord) for r in scan.rule_hits(df).collect()} == python_rule_hits(df.first().content, "php")


def test_long_texts_are_read_whole(spark):

    words = " ".join(f"w{k}" for k in range(60))
    row = spark.createDataFrame([(words, "x " * 800 + "<?php")], "code string, content string").select(
        F.size(T.code_tokens(F.col("code"))).alias("n"), F.length(T.structure_hash(F.col("code"))).alias("h"),
        L.detect(F.lit("file"), F.col("content")).alias("language")).first()
    assert (row.n, row.h, row.language) == (60, 32, "php")


def test_one_pass_finds_what_both_scanners_find(spark):
    from siftline.plans import scan_queries

    df = scan_queries.V.code_files(spark, "/root/testdata/sf0.001")
    odd = spark.createDataFrame([(9001, "x.py", "python", None), (9002, "y.py", "python", "\n\n"), (9003, "z.zig", None, "eval(x)"), (9004, "w.py", "python", "eval(request) # exec(y)\n# eval(z)")],
                                "file_id long, file_path string, language string, content string")
    files = df.select("file_id", "file_path", "language", "content").unionByName(odd)
    both = scan.union_findings(scan.rule_findings(files), scan.keyword_findings(files))
    once = scan.scanned_findings(files)
    assert once.columns == both.columns
    assert sorted(map(repr, once.collect())) == sorted(map(repr, both.collect()))
    assert sum("LocalTableScan" in l or "Scan parquet" in l or "LogicalRDD" in l or "Scan ExistingRDD" in l
               for l in scan.scanned_findings(df)._jdf.queryExecution().executedPlan().toString().splitlines()) == 1


def test_read_tree_lists_folders_by_tasks(spark, tmp_path):
    """Many small files are read by few tasks, and the same files as Spark's own reader finds."""
    names = [f"a{k % 7}/b{k % 3}/f {k}%20é#.py" for k in range(400)]
    names += [".hidden/x.py", "_hidden/x.py", "_k=1/x.py", "a1/.x.py", "a1/_x.py", "a1/x.PY", "a1/x.txt", "top.c", "a1/empty.py"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if "empty" in name else f"eval({len(name)})")
    (tmp_path / "none").mkdir()
    pattern = "*{" + ",".join(fixed.SCAN_EXTENSIONS) + "}"
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(str(tmp_path))
    want = {(r.path.removeprefix("file:"), r.text) for r in plain.select("path", F.col("content").cast("string").alias("text")).collect()}
    for folder in (str(tmp_path), f"{tmp_path}/", f"file:{tmp_path}"):
        found = files.read_tree(spark, folder)
        assert {tuple(r) for r in found.collect()} == want and found.count() == len(want) == 402
    assert "binaryFile" not in found._jdf.queryExecution().toString()
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert files.read_tree(spark, f"{tmp_path}/none").count() == 0


def test_read_tree_of_one_file_and_of_none(spark, tmp_path):
    (tmp_path / "a.py").write_text("x")
    assert [r.content for r in files.read_tree(spark, f"{tmp_path}/a.py").collect()] == ["x"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_tree(spark, f"{tmp_path}/missing").collect()
