"""Run costs: totals, running budget, gates and run status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.values import call_failed, clip, money, or_default
from .ordered import Following, RowNumber, RunningSum, ordered_scan, until_first

RESPONSE_SCHEMA = (
    "usage struct<input_tokens: bigint, output_tokens: bigint>, total_cost_usd double, "
    "is_error boolean, result string, _phase string, _returncode int, _stderr string"
)


def parse_responses(raw: DataFrame, json_col: str = "response") -> DataFrame:
    """Typed run-cost columns from response JSON; every member may be missing."""
    parsed = raw.withColumn("_r", F.from_json(json_col, RESPONSE_SCHEMA))
    keep = [c for c in raw.columns if c != json_col]
    return parsed.select(
        *keep,
        F.col("_r._phase").alias("phase"),
        F.coalesce("_r.total_cost_usd", F.lit(0.0)).alias("cost_usd"),
        F.coalesce("_r.usage.input_tokens", F.lit(0)).alias("input_tokens"),
        F.coalesce("_r.usage.output_tokens", F.lit(0)).alias("output_tokens"),
        call_failed("_r.is_error", "_r._returncode").alias("failed"),
        F.coalesce(F.nullif(F.col("_r.result"), F.lit("")), F.col("_r._stderr"), F.lit("")).alias("error"),
    )


def error_excerpt(error: Column | str = "error", length: int = K.ERROR_TEXT_CHARS) -> Column:
    """The start of an error text, for a report line; tables keep the whole text."""
    return clip(error, length)


def budget_totals(costs: DataFrame, keys: list[str]) -> DataFrame:
    """Cost and token sums and the number of steps, per key."""
    return costs.groupBy(*keys).agg(
        F.round(F.sum(money("cost_usd")), 6).cast("double").alias("total_cost_usd"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).cast("bigint").alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).cast("bigint").alias("output_tokens"),
        F.count(F.lit(1)).alias("phases_run"),
    )


def running_cost(costs: DataFrame, keys: list[str], order: list[str], cost: str = "cost_usd", **kw) -> DataFrame:
    """Adds ``cumulative_usd``."""
    return ordered_scan(costs, keys, order, {"cumulative_usd": RunningSum(money(cost))}, **kw)


def budget_gate(
    costs: DataFrame, keys: list[str], order: list[str], budget: Column, estimate: Column,
    max_steps: Column | None = None, cost: str = "cost_usd", failed: Column | None = None,
    blocked: Column | None = None, **kw,
) -> DataFrame:
    """Which steps run, and why the rest do not.

    A step may start while ``budget - spent >= estimate`` and fewer than ``max_steps``
    steps ran; a step whose cost takes the total strictly above the budget is an overrun.
    Adds ``spent_before`` and ``status``: ``run``, ``golden_missing`` (``blocked`` is
    true), ``budget_skip``, ``overrun``, ``invoke_error`` or ``not_reached``; every status
    other than ``run`` ends the loop.
    """
    def scaled(c: Column) -> Column:
        return c.cast("decimal(28,6)")

    scanned = ordered_scan(
        costs, keys, order,
        {"spent_before": RunningSum(money(cost), inclusive=False), "_step": RowNumber()}, **kw,
    )
    fits = scaled(budget) - F.col("spent_before") >= scaled(estimate)
    if max_steps is not None:
        fits = fits & (F.col("_step") <= max_steps)
    own = (
        F.when(F.coalesce(blocked, F.lit(False)) if blocked is not None else F.lit(False), "golden_missing")
        .when(~fits, "budget_skip")
        .when(F.col("spent_before") + money(cost) > scaled(budget), "overrun")
        .when(failed if failed is not None else F.lit(False), "invoke_error")
        .otherwise("run")
    )
    staged = scanned.withColumn("_own", own)
    return (
        until_first(staged, keys, order, F.col("_own") != "run", **kw)
        .withColumn("status", F.when(F.col("reached"), F.col("_own")).otherwise("not_reached"))
        .drop("_own", "_step", "reached")
    )


def next_stage(steps: DataFrame, keys: list[str], order: list[str], phase: str = "phase", **kw) -> DataFrame:
    """The step each step's output is the entry state of; NULL for the last."""
    return ordered_scan(steps, keys, order, {"next_phase": Following(F.col(phase))}, **kw)


def run_status(mode: Column, failed: Column, violations: Column) -> Column:
    """Status of a step that ran, by mode."""
    return (
        F.when(failed, "invoke_error")
        .when(mode == "harvest", "harvested")
        .when(mode == "update-golden", "golden_written")
        .when(mode == "calibrate", "calibrated")
        .when(violations > 0, "violations")
        .otherwise("ok")
    )


def false_failure_rate(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Failed over calibrated, as a count pair and a ratio; other modes do not count."""
    calibrated = runs.filter("mode = 'calibrate'")
    return calibrated.groupBy(*keys).agg(
        F.count_if("false_failure").alias("failed"),
        F.count(F.lit(1)).alias("calibrated"),
        F.round(F.count_if("false_failure") / F.count(F.lit(1)), 6).alias("rate"),
    )


def effective_budget(mode: Column, cli: Column, asserted: Column, calibrating: Column) -> Column:
    """Budget by precedence; zero counts as unset on every level."""
    def given(c: Column) -> Column:
        return F.when(c > 0, c)

    zero = F.lit(0.0)
    return F.when(
        mode == "assert", F.coalesce(given(cli), given(asserted), given(calibrating), zero)
    ).otherwise(F.coalesce(given(cli), given(calibrating), given(asserted), zero))


def resolve_model(override: Column, by_phase: Column, default: Column, fallback: str) -> Column:
    return F.coalesce(
        *[or_default(c, F.lit(None).cast("string")) for c in (override, by_phase, default)], F.lit(fallback)
    )


def lookup_with_default(rows: DataFrame, table: DataFrame, key: str, value: str, wildcard: str = "*") -> DataFrame:
    """Exact match first, else the wildcard's value, else drop the row."""
    # An empty entry counts as none, and a key given twice has one value.
    given = table.withColumn(value, F.nullif(F.col(value), F.lit(""))).groupBy("key").agg(F.max(value).alias(value))
    exact = given.select(F.col("key").alias(key), F.col(value).alias("_exact"))
    default = given.filter(F.col("key") == wildcard).select(F.max(value)).scalar()
    return (
        rows.join(exact, key, "left")
        .withColumn(value, F.coalesce(F.col("_exact"), default))
        .drop("_exact")
        .filter(F.col(value).isNotNull())
    )


def seed_name(phase: Column, variant: Column) -> Column:
    """Folder of a phase's entry state; a non-numeric label is capitalised."""
    label = F.when(F.rlike(phase, F.lit("^[0-9]+$")), phase).otherwise(F.initcap(phase))
    return F.concat(F.lit("phase"), label, F.lit("-"), variant)


def budget_sizing(costs: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of step costs and the budget derived from it (margin, rounded up to a dollar)."""
    total = F.sum(money("cost_usd"))
    return costs.groupBy(*keys).agg(
        total.cast("double").alias("total_cost_usd"),
        F.ceil(total * F.lit(K.BUDGET_MARGIN).cast("decimal(4,2)")).cast("bigint").alias("suggested_budget"),
    )


def phase_command(rows: DataFrame, commands: DataFrame, phase: str, pattern: str, command: str = "command") -> DataFrame:
    """Command of a phase from the table ``commands``, else from a pattern with the phase at ``{}``."""
    known = commands.groupBy(F.col("phase").alias(phase)).agg(F.max("command").alias("_known"))
    return rows.join(known, phase, "left").withColumn(
        command, F.coalesce("_known", F.replace(F.lit(pattern), F.lit("{}"), F.col(phase)))
    ).drop("_known")
