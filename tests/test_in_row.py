"""What is carried along the lines of a document needs no shuffle: a task's memory does not grow with the corpus."""
from pyspark.sql import functions as F

from doctrellis.functions import text as T
from doctrellis.operators import discovery, facts


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_carried_is_the_last_value_so_far(spark):
    rows = [([],), ([None],), (["a"],), ([None, "a", None, None, "b", "c", None],), (None,)]
    got = spark.createDataFrame(rows, "v array<string>").select(T.carried(F.col("v")).alias("x")).collect()
    assert [r.x for r in got] == [[], [None], ["a"], [None, "a", "a", "a", "b", "c", "c"], None]


def test_code_index_is_built_inside_the_row(spark):
    text = "import a\ndef f(x):\n\n    y = g(h(x), 'f(')\ndef k():\n    return y"
    index = discovery.code_index(spark.createDataFrame([("a.py", text)], "path string, text string"))
    assert "Window" not in plan_of(index.tokens)
    derived = {(r.line, r.symbol): r.derived for r in index.tokens.collect()}
    assert derived[(1, "a")] == [] and derived[(4, "g")] == ["f", "y"] and derived[(6, "y")] == ["k"]


def test_calls_and_payloads_are_read_inside_the_row(spark):
    text = "subagent_type=a\n```\nKEY: 1\n```\nsubagent_type=b"
    calls = facts.agent_calls(spark.createDataFrame([("d.md", text)], "path string, text string"))
    assert "Window" not in plan_of(calls) and "Aggregate" not in plan_of(calls)
    assert sorted((r.line, r.agent, r.parsed, r.passed_required) for r in calls.collect()) == [(1, "a", True, ["KEY"]), (5, "b", False, [])]


def test_diagram_faults_are_found_inside_the_row(spark):
    text = "```mermaid\ngraph LR\nsubgraph a\nsubgraph b\nend\n```\n```py\nend\n```\n```mermaid\ngraph UP\nend\nsubgraph c\nx[\n%% y(\n```"
    found = facts.diagram_faults(spark.createDataFrame([("d.md", text)], "path string, text string"))
    assert "Window" not in plan_of(found)
    assert sorted((r.block, r.line, r.fault) for r in found.collect()) == [
        (1, 3, "open"), (5, 11, "kind"), (5, 12, "end"), (5, 13, "open"), (5, 14, "bracket"),
    ]


def test_lines_are_read_from_hits_alone(spark):
    long = "z = " + " + ".join(f"g{i}(a{i})" for i in range(40))
    text = f"def f(x):\n    y = g(h(x), 'f(')\n    # x\n    {long}"
    index = discovery.code_index(spark.createDataFrame([("a.py", text)], "path string, text string"))
    rows = {(r.line, r.symbol): r for r in index.places.collect()}
    assert rows[(2, "y")].text == "    y = g(h(x), 'f(')" and rows[(2, "y")].read is None
    assert rows[(4, "a1")].text is None and rows[(4, "a1")].read.passed == [("g1", 0)]  # no long text for each name on it
    read = {(r.line, r.symbol): r for r in index.tokens.collect()}
    assert read[(2, "x")].derived == ["f", "y"] and read[(2, "x")].passed == [("h", 0), ("g", 0)]
    assert read[(4, "a39")].derived == ["f", "z"] and read[(4, "a39")].passed == [("g39", 0)] and read[(3, "x")].is_comment


def test_elements_try_each_pattern_once(spark):
    from doctrellis.operators import lint

    rows = lint.elements(spark.createDataFrame([("r.md", "### ＜a＞\n#### UR-1 b\n- **理由：** c")], "path string, text string"))
    assert plan_of(rows).count("^(#+)\\s") == 1
    assert sorted((r.line, r.kind, r.reason) for r in rows.collect()) == [(1, "category", None), (2, "UR", "c")]


def test_scan_goes_on_over_blocks_of_states(spark):
    rows = [([],), (None,), (list(range(2000)),)]
    docs = spark.createDataFrame(rows, "v array<int>")
    sums = docs.select(T.scanned(F.col("v"), "struct<n: int>", lambda last, x: F.struct((F.coalesce(last["n"], F.lit(0)) + x).alias("n"))).alias("s")).collect()
    assert sums[0].s == [] and sums[1].s is None and [s.n for s in sums[2].s] == [i * (i + 1) // 2 for i in range(2000)]


def test_repeated_keys(spark):
    rows = [([],), (["a", None, "b", "a", None],), (["a", "b"],), (["a", "b", "b", "c", "b"],)]
    got = spark.createDataFrame(rows, "v array<string>").select(T.repeated(F.col("v")).alias("x")).collect()
    assert [r.x for r in got] == [[], [True, False, False, True, False], [False, False], [False, True, True, False, True]]


def test_requirements_are_linted_inside_the_row(spark):
    from doctrellis.operators import lint

    text = "\n".join(["### ＜a＞", "#### UR-1 b", "- **理由：** c"] + [f"**＜g{i}＞**\n- **SP-{i % 900}**: s{i}" for i in range(1000)])
    docs = spark.createDataFrame([("r.md", text), ("s.md", "##### ＜x＞\n###### SR-1 y\n- **理由：** z\n- **SP-1**: a\n### ＜b＞\n- **SP-2**: b")], "path string, text string")
    rows, rules = lint.elements(docs), lint.lint_requirements(docs)
    for df in (rows, lint.requirement_paths(rows), rules):
        assert "Window" not in plan_of(df) and "Aggregate" not in plan_of(df)
    found = rules.groupBy("path", "rule").count().collect()
    assert {r.rule: r["count"] for r in found if r.path == "r.md"} == {"id_unique": 200, "spec_under_sub_requirement": 1000, "id_namespace": 1001}
    lines = sorted((r.rule, r.line) for r in rules.filter("path = 's.md'").collect())
    assert lines == [("forced_two_layers", 2), ("id_namespace", 2), ("id_namespace", 4), ("id_namespace", 6), ("spec_under_sub_requirement", 6), ("sub_requirement_has_spec_group", 2)]
    trails = {(r.path, r.line): r.trail for r in lint.requirement_paths(rows).collect()}
    assert trails[("r.md", 5)] == "＜a＞ / UR-1 / ＜g0＞" and trails[("s.md", 4)] == "＜x＞ / SR-1" and trails[("s.md", 6)] == "＜b＞"
