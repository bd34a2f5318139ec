"""Profiles, goldens, requirement lint and traceability on inline documents."""
from pyspark.sql import functions as F

from doctrellis.operators import facts, lint, structure, trace


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "path string, text string")


def test_review_files_are_left_out(spark):
    docs = frame(spark, [("a/x.md", "# A"), ("a/review/y.md", "# B"), ("a/.review-brief.md", "# C"), ("a/reviews/z.md", "# D")])
    assert {r.path for r in structure.document_profiles(docs).collect()} == {"a/x.md", "a/reviews/z.md"}


def test_golden_compare_and_refresh(spark):
    docs = frame(spark, [("p/a.md", "---\nk: 1\n---\n# Head 2026-01-01\nUR-1 {TOK}"), ("p/b.md", "# Other\nSP-2")]).withColumn("doc_set", F.lit("p"))
    actual = structure.set_facts(docs)
    golden = structure.golden_facts(spark.createDataFrame(
        [("p", ["Gone"], ["k", "need"], ["UR-1", "SP-9"], ["Head {DATE}", "Must"])],
        "doc_set string, headings array<string>, frontmatter_keys array<string>, ids array<string>, required_headings array<string>",
    ))
    got = {(r.kind, r.value) for r in structure.compare_with_golden(actual, golden).collect()}
    # Plain golden headings are stored, never required.
    assert got == {("missing_required_heading", "Must"), ("missing_id", "SP-9"), ("missing_frontmatter_key", "need"), ("unreplaced_token", "{TOK}")}
    fresh = {(r.kind, r.value) for r in structure.refresh_golden(golden, actual).collect()}
    assert ("required_heading", "Must") in fresh and ("heading", "Gone") not in fresh and ("id", "SP-2") in fresh
    lonely = structure.without_golden(docs.withColumn("doc_set", F.lit("q")), golden)
    assert [r.doc_set for r in lonely.collect()] == ["q"]


def test_passages_of_every_length(spark):
    items = spark.createDataFrame([
        (1, "alpha beta gamma delta epsilon zeta eta"), (2, "alpha beta gamma wrong epsilon zeta"), (3, "one two three"),
        (4, "ta ga"), (5, "q"), (6, "nowhere"), (7, "pha beta gamma delta epsilon zeta"), (8, "beta gamma  delta"),
    ], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "xx alpha beta gamma delta epsilon zeta etagone"), (2, "zone two threes q"), (3, ""),
    ], "doc_id long, text string")
    got = {r.item_id: r.contained for r in structure.passages_found(items, docs).collect()}
    texts = [r.text for r in docs.collect()]
    assert got == {r.item_id: any(r.text in t for t in texts) for r in items.collect()}
    assert got[1] and got[3] and got[4] and got[5] and got[7] and not got[2] and not got[6] and not got[8]


REQ = """### ＜機能要求＞
#### CR-2026-961-UR-001 検証
- **理由：** 必要
##### ＜範囲＞
###### CR-2026-961-SR-001-001 拒否
- **理由：** 早い
- **説明：** x
**＜範囲チェック＞**
- **CR-2026-961-SP-001-001.001**: 範囲外の値を拒否する
  - **ステータス：** 確定
- **CR-2026-961-SP-001-001.001**: 入力等を扱う
**bad group**
#### UR-002 理由なし
- **理由：**
- **分割軸：** 謎
##### ＜空＞
####### too deep
### ＜別＞
- **CR-2026-961-SP-009**: 孤児
"""


def test_requirement_lint(spark):
    got = sorted((r.rule, r.line) for r in lint.lint_requirements(frame(spark, [("r.md", REQ), ("empty.md", "text")])).collect())
    assert got == sorted([
        ("forced_two_layers", 5), ("id_unique", 9), ("id_unique", 11), ("ambiguous_word", 11),
        ("group_name_form", 12), ("spec_group_has_spec", 12), ("id_namespace", 13), ("reason_required", 13), ("division_axis", 13),
        ("group_has_sub_requirement", 16), ("heading_depth", 17), ("spec_under_sub_requirement", 19), ("document_has_category", 0),
    ])


def test_requirement_trail(spark):
    trails = {r.line: r.trail for r in lint.requirement_paths(lint.elements(frame(spark, [("r.md", REQ)]))).collect()}
    assert trails[9] == "＜機能要求＞ / CR-2026-961-UR-001 / ＜範囲＞ / CR-2026-961-SR-001-001 / ＜範囲チェック＞"
    assert trails[19] == "＜別＞"


def test_traceability_tables_both_layouts(spark):
    one = "| 要求ID | 仕様ID | 設計 |\n|---|---|---|\n| UR-001 | SP-001, SP-002, SP-003 | |\n| UR-002 | SP-004、SP-005 | |\n| UR-003 | SP-006,SP-007,SP-008,SP-009 | |"
    two = "| 要求ID（親） | 要求ID（子） | 仕様ID |\n|---|:-:|---|\n| UR-9 | SR-9 | SP-9 |\n\n| other | table |\n|---|---|\n| a | b | c |"
    table_rows = facts.tables(frame(spark, [("one.md", one), ("two.md", two)]))
    rows = trace.traceability_rows(table_rows)
    counts = {r.ur_id: r["count"] for r in rows.filter("path = 'one.md'").groupBy("ur_id").count().collect()}
    assert counts == {"UR-001": 3, "UR-002": 2, "UR-003": 4}
    assert [(r.ur_id, r.sr_id, r.sp_id) for r in rows.filter("path = 'two.md'").collect()] == [("UR-9", "SR-9", "SP-9")]
    assert [(r.path, r.line, r.expected, r.found) for r in facts.table_column_errors(table_rows).collect()] == [("two.md", 7, 2, 3)]


def test_spec_coverage_names_its_source(spark):
    specs = spark.createDataFrame([(f"SP-{i:03d}",) for i in range(1, 10)], "sp string")
    design = spark.createDataFrame([(f"SP-{i:03d}",) for i in (1, 2, 4, 6, 7)], "sp string")
    files = spark.createDataFrame([(f"SP-{i:03d}",) for i in (1, 2, 3, 4, 5, 6, 7)], "sp string")
    miss = lambda c: sorted(r.sp for r in trace.missing_from(specs, c, ["sp"]).collect())
    assert miss(design) == ["SP-003", "SP-005", "SP-008", "SP-009"] and miss(files) == ["SP-008", "SP-009"]


def test_tally_and_coverage(spark):
    results = spark.createDataFrame([("OK",)] * 11 + [("NG",)], "result string")
    states = spark.createDataFrame([("OK",), ("NG",), ("not run",)], "result string")
    assert {r.result: r.n for r in trace.tally(results, "result", states).collect()} == {"OK": 11, "NG": 1, "not run": 0, "TOTAL": 12}
    rows = spark.createDataFrame([("m", i < 8) for i in range(10)], "k string, hit boolean")
    c = trace.coverage(rows, ["k"], F.col("hit")).first()
    assert (c.total, c.covered, c.uncovered, c.percent, c.passes) == (10, 8, 2, 80.0, True)


def test_unique_candidate_and_collisions(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "sp string")
    cand = spark.createDataFrame([("a", "r1"), ("a", "r1"), ("b", "r1"), ("b", "r2")], "sp string, repo string")
    got = {r.sp: (r.n_candidates, r.repo) for r in trace.unique_candidate(rows, cand, "sp", "repo").collect()}
    assert got == {"a": (1, "r1"), "b": (2, None), "c": (0, None)}
    shared = trace.shared_targets(spark.createDataFrame([("f", "x"), ("f", "y"), ("f", "x"), ("g", "x")], "file string, sp string"), "file", "sp")
    assert sorted((r.file, r.sp, r.n_owners) for r in shared.collect()) == [("f", "x", 2), ("f", "y", 2)]


def test_mermaid(spark):
    text = "```mermaid\ngraph LR\n  a[A x] --> b\n  b -->|calls| c(C)\n  c[open --> d\n```\n  x --> y\n```text\n p --> q\n```"
    docs = frame(spark, [("m.md", text)])
    assert [(r.line, r.src, r.dst) for r in facts.mermaid_edges(docs).orderBy("line").collect()] == [(3, "a", "b"), (4, "b", "c")]
    assert [r.line for r in facts.mermaid_errors(docs).collect()] == [5]


def test_config(spark):
    text = "- `RUN_BUDGET`: `30.0`   # dollars\nMAX_PHASES = 10\nMAX_PHASES: ten\nRUN_BUDGET: bad\nlower: 1"
    pairs = facts.config_pairs(frame(spark, [("c.md", text)]))
    assert {(r.line, r.key, r.value) for r in pairs.collect()} >= {(1, "RUN_BUDGET", "30.0"), (2, "MAX_PHASES", "10")}
    typed = facts.typed_config(pairs, ["RUN_BUDGET"], ["MAX_PHASES"]).first()
    assert (typed.RUN_BUDGET, typed.MAX_PHASES) == (30.0, 10)


def test_config_unit_separator(spark):
    text = "\x1fA: 1\x1f\n-\x1fB\x1f=\x1f`2`\x1f# two\nC: a\x1fb\x1f \nnone"
    pairs = facts.config_pairs(frame(spark, [("c.md", text)]))
    assert sorted((r.line, r.key, r.value) for r in pairs.collect()) == [(1, "A", "1"), (2, "B", "2"), (3, "C", "a\x1fb")]


def test_diagram_faults(spark):
    def faults(*lines):
        text = "before\n```mermaid\n" + "\n".join(lines) + "\n```\nafter ( "
        got = facts.diagram_faults(spark.createDataFrame([("a.md", text)], "path string, text string")).collect()
        return sorted((r.line - 2, r.fault) for r in got)

    assert faults("graph LR", "a[x] --> b((y))", "c{{z}} --> d[(w)]", "e>flag] --> f{q (r)}") == []
    assert faults("graph LR", "a)b(", "a(b[c)]", 'a["(("] --> b', 'a["( --> b', "a(b") == [(2, "bracket"), (3, "bracket"), (5, "quote"), (6, "bracket")]
    assert faults("graph UP", "a --> b") == [(1, "kind")] and faults("", "%% note", "a --> b") == [(3, "kind")]
    assert faults("flowchart TD;", "subgraph one", "subgraph two", "end", "x[end] --> y") == [(2, "open")]
    assert faults("flowchart TD", "end", "subgraph a", "end", "end") == [(2, "end"), (5, "end")]
    assert faults("sequenceDiagram", "loop each", "A->>B: hi (there)", "end", "alt x") == [(5, "open")]
    assert faults("classDiagram", "class A {", "+run(x) int", "}", "class B {") == [(5, "open")]
    assert faults("erDiagram", "A ||--o{ B : has", "B }o--|| C : is", "A {", "int id", "}") == []
    assert faults("pie title Pets", '"Dogs" : 3') == []
    docs = spark.createDataFrame([("a.md", '```mermaid\ngraph LR\na[x --> y] --> b("p --> q)") --> c\n```')], "path string, text string")
    assert [(r.src, r.dst) for r in facts.mermaid_edges(docs).orderBy("src").collect()] == [("a", "b"), ("b", "c")]
