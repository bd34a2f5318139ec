"""Ordered-scan operators over events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger
from ..operators.discovery import number_rows
from ..operators.ordered import (
    Following, LastValue, NextValue, RowNumber, RunningSum, ordered_scan, runs_of_equal, until_first,
)
from ..operators.trace import latest_per
from .registry import query, table

_ORDER = ["ts", "event_id"]
_W = "PARTITION BY user_id ORDER BY ts, event_id"
_DEC = "CAST(value AS DECIMAL(28,6))"


def _events(spark, folder, *columns):
    return table(spark, folder, "events").select("event_id", "ts", "user_id", *columns)


@query("asof_preceding", f"""
SELECT event_id, v AS view_id FROM (SELECT event_id, event_type,
 last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM events)
WHERE event_type = 'purchase'""")
def asof_preceding(spark, folder):
    """Each purchase with the user's latest view at or before it."""
    rows = _events(spark, folder, "event_type").filter(F.col("event_type").isin("view", "purchase"))
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    return ordered_scan(rows, ["user_id"], _ORDER, {"view_id": LastValue(view)}).filter(
        "event_type = 'purchase'"
    ).select("event_id", "view_id")


@query("budget_running", f"""
SELECT event_id, sum({_DEC}) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS cumulative_usd FROM events""")
def budget_running(spark, folder):
    rows = _events(spark, folder, F.col("value").alias("cost_usd"))
    return ledger.running_cost(rows, ["user_id"], _ORDER).select("event_id", F.col("cumulative_usd").cast("double").alias("cumulative_usd"))


@query("budget_gate", f"""
WITH s AS (SELECT event_id, user_id, ts, {_DEC} AS c, event_type = 'error' AND value > 25 AS failed,
  coalesce(sum({_DEC}) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  row_number() OVER ({_W}) AS n FROM events),
o AS (SELECT *, CASE WHEN NOT (300 - before >= 8 AND n <= 40) THEN 'budget_skip' WHEN before + c > 300 THEN 'overrun'
  WHEN failed THEN 'invoke_error' ELSE 'run' END AS own FROM s),
r AS (SELECT *, coalesce(sum(CASE WHEN own <> 'run' THEN 1 ELSE 0 END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM o)
SELECT event_id, before::DOUBLE AS spent_before, CASE WHEN stops = 0 THEN own ELSE 'not_reached' END AS status FROM r""")
def budget_gate(spark, folder):
    rows = _events(spark, folder, F.col("value").alias("cost_usd"), "event_type")
    return ledger.budget_gate(
        rows, ["user_id"], _ORDER, budget=F.lit(300), estimate=F.lit(8), max_steps=F.lit(40),
        failed=(F.col("event_type") == "error") & (F.col("cost_usd") > 25),
    ).select("event_id", F.col("spent_before").cast("double").alias("spent_before"), "status")


@query("loop_until_stop", f"""
WITH f AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM events)
SELECT user_id, count(*) FILTER (s = 0) AS reached_rows, count(*) AS all_rows FROM f GROUP BY 1""")
def loop_until_stop(spark, folder):
    rows = until_first(_events(spark, folder, "event_type"), ["user_id"], _ORDER, F.col("event_type") == "error")
    return rows.groupBy("user_id").agg(F.count_if("reached").alias("reached_rows"), F.count(F.lit(1)).alias("all_rows"))


@query("budget_totals", f"""
SELECT user_id, sum({_DEC})::DOUBLE AS total_cost_usd, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS input_tokens,
 0::BIGINT AS output_tokens, count(*) AS phases_run FROM events GROUP BY 1""")
def budget_totals(spark, folder):
    rows = table(spark, folder, "events").select(
        "user_id", F.col("value").alias("cost_usd"),
        F.get_json_object("props", "$.k").cast("bigint").alias("input_tokens"), F.lit(None).cast("bigint").alias("output_tokens"),
    )
    return ledger.budget_totals(rows, ["user_id"])


@query("response_fields", """
SELECT event_id, event_type AS phase, CASE WHEN event_type = 'signup' THEN 0 ELSE value END AS cost_usd,
 CASE WHEN event_type = 'view' THEN 0 ELSE user_id END AS input_tokens, CASE WHEN event_type = 'view' THEN 0 ELSE event_id END AS output_tokens,
 event_type IN ('error', 'click') AS failed, CASE WHEN event_type = 'error' THEN 'broken' ELSE repeat('stderr ' || event_id || ' ', 40) END AS error FROM events""")
def response_fields(spark, folder):
    """Run responses with optional members, rendered as JSON and read back typed."""
    kind = F.col("event_type")
    response = F.to_json(F.struct(
        F.when(kind != "view", F.struct(F.col("user_id").alias("input_tokens"), F.col("event_id").alias("output_tokens"))).alias("usage"),
        F.when(kind != "signup", F.col("value")).alias("total_cost_usd"),
        F.when(kind == "error", F.lit(True)).alias("is_error"),
        F.when(kind == "error", F.lit("broken")).when(kind == "click", F.lit("")).alias("result"),
        kind.alias("_phase"),
        F.when(kind == "click", F.lit(2)).when(kind == "purchase", F.lit(0)).alias("_returncode"),
        F.repeat(F.concat(F.lit("stderr "), F.col("event_id").cast("string"), F.lit(" ")), 40).alias("_stderr"),
    ))
    return ledger.parse_responses(table(spark, folder, "events").select("event_id", response.alias("response")))


@query("section_ffill", """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations""")
def section_ffill(spark, folder):
    """The latest user turn decides the section the following turns belong to."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role")
    return ordered_scan(rows, ["conv_id"], ["turn"], {"section": LastValue(F.when(F.col("role") == "user", F.col("turn")))}).select(
        "conv_id", "turn", "section"
    )


@query("continuation_merge", f"""
WITH p AS (SELECT *, lag(event_type) OVER ({_W}) AS b FROM events),
g AS (SELECT *, sum(CASE WHEN b IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_no FROM p)
SELECT user_id, run_no::BIGINT AS run_no, event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM g GROUP BY 1, 2, 3""")
def continuation_merge(spark, folder):
    runs = runs_of_equal(_events(spark, folder, "event_type"), ["user_id"], _ORDER, "event_type")
    return runs.groupBy("user_id", "run_no", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@query("fence_window", f"""
WITH n AS (SELECT *, row_number() OVER ({_W}) AS n FROM events),
f AS (SELECT event_id, n, min(CASE WHEN event_type = 'error' THEN n END) OVER ({_W} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS e FROM n)
SELECT event_id, (e - n)::BIGINT AS distance FROM f""")
def fence_window(spark, folder):
    """Distance to the first error on the row or the three rows below it."""
    numbered = ordered_scan(_events(spark, folder, "event_type"), ["user_id"], _ORDER, {"n": RowNumber()})
    ahead = ordered_scan(
        numbered, ["user_id"], ["n"], {"at": NextValue(F.when(F.col("event_type") == "error", F.col("n")))}
    )
    distance = F.col("at") - F.col("n")
    return ahead.select("event_id", F.when(distance <= 3, distance).alias("distance"))


@query("lead_stage", f"SELECT event_id, lead(event_type) OVER ({_W}) AS next_phase FROM events")
def lead_stage(spark, folder):
    return ledger.next_stage(
        _events(spark, folder, "event_type"), ["user_id"], _ORDER, phase="event_type"
    ).select("event_id", "next_phase")


@query("wave_numbering", """
SELECT event_id, 'W' || strftime(ts, '%d') || '-R' || row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS row_id FROM events""")
def wave_numbering(spark, folder):
    rows = _events(spark, folder).withColumn("day", F.date_format("ts", "dd")).withColumn("date", F.to_date("ts"))
    # nothing bounds the events of a day
    numbered = ordered_scan(rows, ["date"], _ORDER, {"n": RowNumber()}, segments=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return number_rows(numbered, "day", "R", "n").select("event_id", "row_id")


@query("status_precedence", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'invoke_error' WHEN event_type = 'view' THEN 'harvested' WHEN event_type = 'click' THEN 'golden_written'
 WHEN event_type = 'signup' THEN 'calibrated' WHEN value > 10 THEN 'violations' ELSE 'ok' END AS status FROM events""")
def status_precedence(spark, folder):
    mode = (
        F.when(F.col("event_type") == "view", "harvest").when(F.col("event_type") == "click", "update-golden")
        .when(F.col("event_type") == "signup", "calibrate").otherwise("assert")
    )
    return table(spark, folder, "events").select(
        "event_id", ledger.run_status(mode, F.col("event_type") == "error", F.when(F.col("value") > 10, 1).otherwise(0)).alias("status")
    )


@query("budget_precedence", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN (CASE WHEN c_acctbal > 0 THEN c_acctbal WHEN c_nationkey > 0 THEN c_nationkey ELSE c_custkey END)
 ELSE (CASE WHEN c_acctbal > 0 THEN c_acctbal WHEN c_custkey > 0 THEN c_custkey ELSE c_nationkey END) END::DOUBLE AS budget FROM customer""")
def budget_precedence(spark, folder):
    mode = F.when(F.col("c_mktsegment") == "BUILDING", "assert").otherwise("calibrate")
    return table(spark, folder, "customer").select(
        "c_custkey",
        ledger.effective_budget(mode, F.col("c_acctbal"), F.col("c_nationkey").cast("double"), F.col("c_custkey").cast("double")).alias("budget"),
    )


@query("budget_sizing", f"""
SELECT event_type, sum({_DEC})::DOUBLE AS total_cost_usd, ceil(sum({_DEC}) * 1.5)::BIGINT AS suggested_budget FROM events GROUP BY 1""")
def budget_sizing(spark, folder):
    return ledger.budget_sizing(table(spark, folder, "events").select("event_type", F.col("value").alias("cost_usd")), ["event_type"])


@query("latest_state", """
SELECT user_id, arg_max(event_type, {'t': ts, 'i': event_id}) AS event_type, arg_max(event_id, {'t': ts, 'i': event_id}) AS event_id FROM events GROUP BY 1""")
def latest_state(spark, folder):
    """Same key written by several runs: the latest wins."""
    return latest_per(_events(spark, folder, "event_type"), ["user_id"], _ORDER).select("user_id", "event_type", "event_id")


@query("running_error_share", f"""
SELECT event_id, (sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS errors,
 row_number() OVER (ORDER BY ts, event_id) AS seen, lead(event_id) OVER (ORDER BY ts, event_id) AS next_id FROM events""")
def running_error_share(spark, folder):
    """One ledger for everything: the whole table is a single ordered group."""
    rows = _events(spark, folder, "event_type").withColumn("ledger", F.lit("all"))
    one = F.when(F.col("event_type") == "error", F.lit(1)).otherwise(F.lit(0))
    return ordered_scan(
        rows, ["ledger"], _ORDER,
        {"errors": RunningSum(one), "seen": RowNumber(), "next_id": Following(F.col("event_id"))},
        # One key by design, so it is cut into segments.
        segments=int(spark.conf.get("spark.sql.shuffle.partitions")),
    ).select("event_id", "errors", "seen", "next_id")
