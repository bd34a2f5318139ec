"""File sources, sinks and streaming flows on small trees."""
import json
import random
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from doctrellis.operators import report, structure
from doctrellis.operators.ledger import budget_gate
from doctrellis.sources import files, sinks
from doctrellis.streaming import flows

from test_ledger_merge import reference_gate


def write(root, rel, text):
    path = root / rel
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_read_tree(spark, tmp_path):
    write(tmp_path, "a.md", "top\n")
    write(tmp_path, "sub dir/b+c.md", "# 見出し")
    write(tmp_path, "sub dir/skip.txt", "no")
    got = {r.path: r.text for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "top\n", "sub dir/b+c.md": "# 見出し"}
    assert [r.path for r in files.read_tree(spark, str(tmp_path), recursive=False).collect()] == ["a.md"]


def test_goldens_and_corrupt_golden(spark, tmp_path):
    write(tmp_path, "phase02.json", json.dumps({"headings": ["A"], "ids": ["UR-1"], "required_headings": ["A"]}, indent=2))
    write(tmp_path, "phase03.json", "{ not json")
    got = {r.doc_set: r for r in files.read_goldens(spark, str(tmp_path)).collect()}
    assert got["phase02"].headings == ["A"] and got["phase02"].frontmatter_keys is None and not got["phase02"].corrupt
    assert got["phase03"].corrupt and got["phase03"].headings is None
    facts = structure.golden_facts(files.read_goldens(spark, str(tmp_path)))
    assert {(r.kind, r.value) for r in facts.collect()} == {("heading", "A"), ("id", "UR-1"), ("required_heading", "A")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("02", 1, "é")], "phase string, n int, t string")
    log = str(tmp_path / "log")
    sinks.append_log(df, log)
    sinks.append_log(df, log)
    assert files.read_log(spark, log, "phase string, n int, t string").count() == 2
    once = str(tmp_path / "once")
    sinks.write_if_absent(df, once)
    sinks.write_if_absent(df.withColumn("n", F.lit(9)), once)
    assert spark.read.parquet(once).first().n == 1
    sinks.write_snapshot(df.withColumn("n", F.lit(9)), once)
    assert spark.read.parquet(once).first().n == 9
    sinks.write_responses(df, str(tmp_path / "raw"))
    assert spark.read.json(str(tmp_path / "raw")).first().t == "é"


def test_goldens_are_read_back_as_they_were_written(spark, tmp_path):
    docs = [("01", "# A\nUR-1"), ("002", "# B"), ("10%/x y", "# C"), ("名", "# D")]
    profiles = structure.document_profiles(spark.createDataFrame(docs, "path string, text string"))
    root = str(tmp_path / "goldens")
    sinks.write_goldens(sinks.golden_json(profiles).withColumnRenamed("path", "doc_set"), root)
    want = {("01", "A"), ("002", "B"), ("10%/x y", "C"), ("名", "D")}
    assert {(r.doc_set, json.loads(r.json)["headings"][0]) for r in sinks.read_golden_files(spark, root).collect()} == want
    read = files.read_goldens(spark, root)
    assert {(r.doc_set, r.headings[0]) for r in read.collect()} == want and read.filter("corrupt").count() == 0


def test_reports_as_files(spark, tmp_path):
    found = spark.createDataFrame([("b.md", 3, "error", "X", "late"), ("a.md", 10, "error", "X", "two"), ("a.md", 9, "warning", "Y", "one"), ("a.md", 0, "error", "Z", "whole")],
                                  "file string, line int, severity string, check string, message string")
    sinks.write_report(report.render_text(found), str(tmp_path / "report"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "report")).orderBy(F.col("_metadata.file_name"), F.monotonically_increasing_id()).collect()]
    assert lines == ["❌ [Z] a.md  whole", "⚠️ [Y] a.md:9  one", "❌ [X] a.md:10  two", "❌ [X] b.md:3  late"]
    assert report.render_lint_totals(found).first().rendered == "checks: errors=3 warnings=1"
    assert report.render_lint_totals(found.limit(0)).first().rendered == "checks: errors=0 warnings=0"
    cells = spark.createDataFrame([("r1", "c", "x y"), ("r2", "c", None)], "row string, column string, value string")
    sinks.write_tsv(cells, str(tmp_path / "tsv"))
    assert [f.read_text().splitlines()[0] for f in (tmp_path / "tsv").glob("part-*.csv")][0] == "row\tcolumn\tvalue"


def test_runs_and_suites_as_lines(spark):
    runs = spark.createDataFrame([("a", "assert", "m", "ok", 1.25, None, None), ("b", "calibrate", "m", "violations", None, ["x", "y"], True), ("c", "calibrate", "m", "ok", 0.5, [], False)],
                                 "seed string, mode string, model string, status string, cost_usd double, violations array<string>, false_failure boolean")
    got = {(r.seed, r.line): r.rendered for r in report.render_runs(runs).collect()}
    assert got == {("a", 0): "[a] mode=assert model=m -> ok ($1.2500)", ("b", 0): "[b] mode=calibrate model=m -> violations", ("b", 1): "    ✗ x", ("b", 2): "    ✗ y",
                   ("c", 0): "[c] mode=calibrate model=m -> ok ($0.5000)"}
    assert [r.rendered for r in report.render_run_totals(runs, 2).orderBy("line").collect()] == ["偽失敗率: 1/2", "累積コスト: $1.7500 / 上限 $2.0000（工程数 2）"]
    assert [r.rendered for r in report.render_run_totals(runs.filter("seed = 'a'"), 2).collect()] == ["累積コスト: $1.2500 / 上限 $2.0000（工程数 1）"]
    assert json.loads(report.runs_json(runs).filter("seed = 'b'").first().json)["violations"] == ["x", "y"]
    suites = spark.createDataFrame([("t/a", True, "3 tests", "noise"), ("t/b", False, "1 failed", "E 1\nE 2\n"), ("t/c", False, "none", None)], "dir string, ok boolean, summary string, output string")
    assert {(r.dir, r.line): r.rendered for r in report.render_suites(suites).collect()} == {
        ("t/a", 0): "✅ t/a  3 tests", ("t/b", 0): "❌ t/b  1 failed", ("t/b", 1): "E 1", ("t/b", 2): "E 2", ("t/c", 0): "❌ t/c  none"}


def test_pretty_golden_json_keeps_text(spark):
    docs = spark.createDataFrame([("a.md", "# 見出し\nUR-1")], "path string, text string")
    text = sinks.golden_json(structure.document_profiles(docs)).first().json
    assert json.loads(text)["headings"] == ["見出し"] and "見出し" in text and "\n" in text


def test_folders_and_staging(spark):
    dirs = spark.createDataFrame([("CR-2/02_analysis",), ("CR-1/02_analysis",)], "path string").withColumn("path", F.concat(F.lit("w/"), "path"))
    wanted = spark.createDataFrame([("02", "w", "02_analysis"), ("03", "w", "03_x")], "key string, parent string, name string")
    assert {r.key: r.folder for r in files.first_folder(dirs, wanted, "w").collect()} == {"02": "w/CR-1/02_analysis", "03": "w"}
    row = spark.range(1).select(
        files.staged_path(F.lit("phase02-single"), F.lit("multi/svc/x")).alias("a"), files.staged_path(F.lit("phase04-multi"), F.lit("multi/svc/x")).alias("b"),
        files.staged_path(F.lit("phase04-multi"), F.lit("x")).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == ("multi/svc/x", None, "ws/x")
    rows = spark.createDataFrame([("a", "02", None), ("b", "99", None), ("c", "02", "own")], "k string, phase string, own string")
    table = spark.createDataFrame([("02", "work/CR-*/two")], "phase string, pattern string")
    assert {r.k: r.folder for r in files.artifact_globs(rows, table, "phase", "own").collect()} == {"a": "work/CR-*/two", "b": None, "c": "own"}
    tests = spark.createDataFrame([("a/tests/test_x.py",), ("a/tests/test_y.py",), ("a/tests/sub/test_z.py",), ("b/test_q.py",)], "path string")
    assert [(r.suite, r.modules) for r in files.test_suites(tests).collect()] == [("a/tests", 2)]


def put(spark, folder, rows, schema):
    """One more file."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def state_bytes(folder):
    """Bytes of the state's logs by version."""
    sizes = Counter()
    for file in folder.glob("state/*/*/**/*.changelog"):
        sizes[int(file.name.split(".")[0].split("_")[0])] += file.stat().st_size
    return sizes


def test_upserts_in_disorder(spark, tmp_path):
    """A later batch with an older row doesn't win, and a batch that comes again changes nothing."""
    schema = "k string, v string, seq int"
    batches = [[("a", "new", 5), ("b", "x", 1)], [("a", "old", 2), ("b", "y", 3)], [("c", "z", 0), ("a", "newest", 9)], [("a", "late", 7), ("c", "zz", 0), (None, "n", 1)]]
    for rows in [*batches, batches[1]]:
        put(spark, tmp_path / "in", rows, schema)
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        flows.upsert_stream(stream, ["k"], str(tmp_path / "log"), str(tmp_path / "changes")).awaitTermination()
    got = {(r.k, r.v, r.seq) for r in flows.upserted(spark, str(tmp_path / "log")).collect()}
    assert got == {("a", "newest", 9), ("b", "y", 3), ("c", "zz", 0), (None, "n", 1)}
    third = {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "changes/batch=3")).collect()}
    assert third == {("a", "newest"), ("c", "zz"), (None, "n")}


def test_what_an_upsert_writes_follows_the_batch(spark, tmp_path):
    schema, sizes = "k long, v string, seq int", [20_000, 40, 40, 40]
    for n, size in enumerate(sizes):
        put(spark, tmp_path / "in", [(i * (1 + n), f"row {i} of batch {n}", n) for i in range(size)], schema)
        flows.upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["k"], str(tmp_path / "log"), retained=1).awaitTermination()
    table = flows.upserted(spark, str(tmp_path / "log"))
    want = {i * (1 + n): (n, f"row {i} of batch {n}") for n, size in enumerate(sizes) for i in range(size)}
    assert {r.k: (r.seq, r.v) for r in table.collect()} == want
    sizes = state_bytes(tmp_path / "log")
    assert sizes[4] and sizes[1] > 50 * sizes[4]


def test_state_settings_are_put_back(spark):
    name = "spark.sql.streaming.minBatchesToRetain"
    before = spark.conf.get(name)
    with flows.state_store(spark, 3):
        assert spark.conf.get(name) == "3"
    assert spark.conf.get(name) == before


GATE_ROWS = "k string, seq int, cost_usd double, bad boolean"


@pytest.mark.parametrize("seed", [0, 1])
def test_gate_over_files_in_any_order_equals_one_pass(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(k, i, ((i * 7 + ord(k)) % 10) / 10, (i, k) in ((3, "c"), (30, "b"))) for i in range(40) for k in "abc"]
    rng.shuffle(rows)
    parts = [rows[:7], rows[7:60], rows[60:61], rows[61:], rows[5:9]]  # the last one comes again
    for n, part in enumerate(parts):
        put(spark, tmp_path / "in", part, GATE_ROWS)
        stream = spark.readStream.schema(GATE_ROWS).parquet(str(tmp_path / "in"))
        flows.gate_stream(
            stream, ["k"], ["seq"], 9.0, 0.3, 25, str(tmp_path / "rows"), str(tmp_path / "log"), failed=F.col("bad"),
        ).awaitTermination()
        so_far = {r[:2]: r for p in parts[:n + 1] for r in p}.values()
        batch = budget_gate(
            spark.createDataFrame(list(so_far), GATE_ROWS), ["k"], ["seq"], F.lit(9.0), F.lit(0.3), F.lit(25), failed=F.col("bad"))
        got = {(r.k, r.seq): r.status for r in flows.gated(spark, str(tmp_path / "rows"), ["k"], ["seq"]).collect()}
        assert got == {(r.k, r.seq): r.status for r in batch.collect()}
    want = {(k, s): v for k in "a" for s, v in reference_gate([(r[1], r[2], False, False) for r in sorted(rows) if r[0] == k], 9.0, 0.3, 25).items()}
    assert {x: y for x, y in got.items() if x[0] == "a"} == want


def test_gate_of_a_busy_key_in_small_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(flows.GateKey, "CHUNK", 7)
    rows = [("hot", i, 0.25 if i % 3 else None, False) for i in range(300)] + [("cold", 1, 5.0, False), ("cold", 2, 6.0, False)]
    random.Random(4).shuffle(rows)
    put(spark, tmp_path / "in", rows, GATE_ROWS)
    stream = spark.readStream.schema(GATE_ROWS).parquet(str(tmp_path / "in"))
    flows.gate_stream(stream, ["k"], ["seq"], 9.0, 0.3, None, str(tmp_path / "rows"), str(tmp_path / "log")).awaitTermination()
    batch = budget_gate(spark.createDataFrame(rows, GATE_ROWS), ["k"], ["seq"], F.lit(9.0), F.lit(0.3))
    got = {(r.k, r.seq): r.status for r in flows.gated(spark, str(tmp_path / "rows"), ["k"], ["seq"]).collect()}
    assert got == {(r.k, r.seq): r.status for r in batch.collect()}
    held = spark.read.format("statestore").option("stateVarName", "reached").load(str(tmp_path / "log")).count()
    assert held < 60  # of 302 rows


def test_gate_refuses_negative_costs(spark, tmp_path):
    put(spark, tmp_path / "in", [("a", 1, -1.0, False)], GATE_ROWS)
    stream = spark.readStream.schema(GATE_ROWS).parquet(str(tmp_path / "in"))
    with pytest.raises(StreamingQueryException, match="negative cost"):
        flows.gate_stream(stream, ["k"], ["seq"], 9.0, 0.3, 25, str(tmp_path / "rows"), str(tmp_path / "log")).awaitTermination()


def test_windowed_totals_drop_late_rows(spark, tmp_path):
    schema = "k string, ts timestamp, cost_usd double"
    for n, batch in enumerate([[("a", "2024-01-01 00:01:00", 1.0)], [("a", "2024-01-01 02:00:00", 2.0)], [("a", "2024-01-01 00:02:00", 5.0), ("a", "2024-01-01 04:00:00", 1.0)]]):
        rows = spark.createDataFrame(batch, "k string, ts string, cost_usd double").withColumn("ts", F.to_timestamp("ts"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = flows.windowed_totals(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", "ts", "1 hour", "10 minutes")
        flows.run_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "log"))
    got = {(str(r.start), r.total_cost_usd) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("2024-01-01 00:00:00", 1.0) in got and not any(t == 6.0 for _, t in got)
