"""Budgets, gates, merges on inline rows; both scan paths of the gate."""
import random

import pytest
from pyspark.sql import functions as F

from doctrellis.operators import ledger, merge, report


def test_totals_from_responses(spark):
    raw = spark.createDataFrame([
        ("r", 1, '{"usage":{"input_tokens":100,"output_tokens":50},"total_cost_usd":0.1,"_phase":"02"}'),
        ("r", 2, '{"usage":{"input_tokens":10,"output_tokens":5},"total_cost_usd":0.2,"_returncode":0}'),
    ], "run string, seq int, response string")
    t = ledger.budget_totals(ledger.parse_responses(raw), ["run"]).first()
    assert (t.total_cost_usd, t.input_tokens, t.output_tokens, t.phases_run) == (0.3, 110, 55, 2)


def test_response_defaults(spark):
    raw = spark.createDataFrame([
        (1, "{}"), (2, '{"is_error":true,"result":"limit hit"}'), (3, '{"_returncode":1,"_stderr":"boom","result":""}'),
        (4, '{"usage":null,"total_cost_usd":null,"is_error":false}'), (5, '{"result":"' + "x" * 500 + '"}'),
    ], "id int, response string")
    got = {r.id: r for r in ledger.parse_responses(raw).collect()}
    assert (got[1].cost_usd, got[1].failed, got[1].error) == (0.0, False, "")
    assert got[2].failed and got[2].error == "limit hit"
    assert got[3].failed and got[3].error == "boom"
    assert not got[4].failed and got[4].input_tokens == 0 and len(got[5].error) == 500


def reference_gate(rows, budget, estimate, max_steps):
    spent, steps, out, stopped = 0.0, 0, {}, False
    for seq, cost, failed, blocked in rows:
        if stopped:
            out[seq] = "not_reached"
            continue
        if blocked:
            status = "golden_missing"
        elif steps >= max_steps or round(budget - spent, 6) < estimate:
            status = "budget_skip"
        else:
            spent, steps = round(spent + cost, 6), steps + 1
            status = "overrun" if spent > budget else "invoke_error" if failed else "run"
        out[seq] = status
        stopped = status != "run"
    return out


@pytest.mark.parametrize("segments", [None, 6])
def test_budget_gate(spark, segments):
    rng = random.Random(3)
    data = {k: [(i, round(rng.random(), 2), rng.random() < 0.02, rng.random() < 0.02) for i in range(60)] for k in "abcd"}
    data["edge"] = [(0, 0.5, False, False), (1, 0.5, False, False), (2, 0.0, False, False), (3, 9.0, False, False), (4, 0.0, False, False)]
    df = spark.createDataFrame([(k, *r) for k, rs in data.items() for r in rs], "k string, seq int, cost_usd double, failed boolean, blocked boolean")
    got = ledger.budget_gate(
        df, ["k"], ["seq"], F.lit(10.0), F.lit(0.1), F.lit(25), failed=F.col("failed"), blocked=F.col("blocked"),
        segments=segments,
    ).collect()
    want = {(k, s): v for k, rs in data.items() for s, v in reference_gate(rs, 10.0, 0.1, 25).items()}
    assert {(r.k, r.seq): r.status for r in got} == want


def test_gate_boundaries(spark):
    """Admission takes an exact fit; an overrun is strictly above the budget."""
    df = spark.createDataFrame([("k", 1, 0.7), ("k", 2, 0.3), ("k", 3, 0.1)], "k string, seq int, cost_usd double")
    gate = lambda b, e: [r.status for r in ledger.budget_gate(df, ["k"], ["seq"], F.lit(b), F.lit(e)).orderBy("seq").collect()]
    assert gate(1.0, 0.3) == ["run", "run", "budget_skip"]
    assert gate(1.0, 0.31) == ["run", "budget_skip", "not_reached"]
    assert gate(0.9, 0.0) == ["run", "overrun", "not_reached"]


def test_lookup_with_default(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "stem string")
    table = spark.createDataFrame([("a", "m1"), ("*", "m2")], "key string, model string")
    assert {r.stem: r.model for r in ledger.lookup_with_default(rows, table, "stem", "model").collect()} == {"a": "m1", "b": "m2"}
    only = table.filter("key = 'a'")
    assert [r.stem for r in ledger.lookup_with_default(rows, only, "stem", "model").collect()] == ["a"]


def test_effective_budget_zero_is_unset(spark):
    b = lambda mode, *v: spark.range(1).select(ledger.effective_budget(F.lit(mode), *[F.lit(float(x)) for x in v]).alias("b")).first().b
    assert b("assert", 0, 5, 7) == 5 and b("assert", 0, 0, 7) == 7 and b("calibrate", 0, 5, 7) == 7
    assert b("calibrate", 0, 5, 0) == 5 and b("assert", 3, 5, 7) == 3 and b("assert", 0, 0, 0) == 0


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", "q")], "id int, v string, w string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(merge.upsert(old, new, ["id"])) == [(1, "a", "x"), (2, "b", "z"), (3, "c", "q")]
    assert {r.id: (r.v, r.w) for r in merge.upsert_rows(old, new, ["id"]).collect()}[2] == (None, "z")
    assert rows(merge.add_missing(old, new, ["id"])) == [(3, "c", "q")]
    assert {r.id for r in merge.replace_scope(old, new, ["id"]).collect()} == {1, 2, 3}
    sync = merge.sync_actions(
        spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "path string, mtime int"),
        spark.createDataFrame([("a", 5), ("b", 4)], "path string, mtime int"),
    )
    assert {r.path: r.action for r in sync.collect()} == {"a": "skipped", "b": "updated", "c": "copied"}
    notes = spark.createDataFrame([("s1", False), ("s1", True), ("s2", False)], "step string, is_history boolean")
    done = spark.createDataFrame([("s1",)], "step string")
    assert sorted((r.step, r.is_history) for r in merge.clear_notes(notes, done).collect()) == [("s1", True), ("s2", False)]


def test_one_failed_repo_fails_the_whole(spark):
    got = {r.repo: (r.ok, r.failures) for r in merge.repo_outcome(spark.createDataFrame([("a", True), ("b", False)], "repo string, ok boolean")).collect()}
    assert got == {"a": (True, 0), "b": (False, 1), "ALL": (False, 1)}


def test_report(spark):
    v = spark.createDataFrame([("A", "error", "f.md", 3, "m"), ("C", "warning", "t.md", 0, "n")], "check string, severity string, file string, line int, message string")
    s = report.summarize(v).first()
    assert (s.errors, s.warnings, s.total, s.ok) == (1, 1, 2, False)
    assert sorted(r.rendered for r in report.render_text(v).collect()) == ["⚠️ [C] t.md  n", "❌ [A] f.md:3  m"]
    assert report.summarize(v.filter("false")).first().ok
