"""Summaries and renderings of check results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import lines_of
from ..functions.values import money


def summarize(violations: DataFrame) -> DataFrame:
    """One row: errors, warnings, total and the overall verdict."""
    errors = F.count_if(F.col("severity") == "error")
    return violations.agg(
        errors.alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count(F.lit(1)).alias("total"),
        (errors == 0).alias("ok"),
    )


def summarize_by_check(violations: DataFrame) -> DataFrame:
    return violations.groupBy("check", "severity").agg(F.count(F.lit(1)).alias("n"))


def suite_verdict(suites: DataFrame, stage: str = "stage") -> DataFrame:
    """Logical AND of suite results per stage."""
    return suites.groupBy(stage).agg(F.bool_and("ok").alias("ok"), F.count(F.lit(1)).alias("suites"))


def render_text(violations: DataFrame) -> DataFrame:
    """One readable line per violation; line 0 means "whole file" and is left out."""
    place = F.when(F.col("line") > 0, F.concat_ws(":", "file", F.col("line").cast("string"))).otherwise(F.col("file"))
    mark = F.when(F.col("severity") == "error", "❌").otherwise("⚠️")
    return violations.select(
        "file", "line", F.format_string("%s [%s] %s  %s", mark, F.col("check"), place, F.col("message")).alias("rendered")
    )


def render_json(violations: DataFrame) -> DataFrame:
    return violations.select(F.to_json(F.struct("check", "severity", "file", "line", "message")).alias("json"))


def unpivot_cells(rows: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """Every cell as ``(row, column, value)`` and a tab-separated line."""
    cells = rows.select(id_column, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        id_column, columns, "column", "value"
    )
    return cells.withColumn(
        "tsv", F.concat_ws("\t", F.col(id_column).cast("string"), "column", F.coalesce("value", F.lit("")))
    )


def dollars(c: Column | str) -> Column:
    return money(c, 4).cast("decimal(28,4)").cast("string")


def render_runs(runs: DataFrame) -> DataFrame:
    """``(seed, line, rendered)``: a line per run ``(seed, mode, model, status, cost_usd, violations)``, then one per violation.

    A run without a cost has none in its line; null violations are none.
    """
    head = F.concat(
        F.format_string(K.RUN_LINE, "seed", "mode", "model", "status"),
        F.when(F.col("cost_usd").isNotNull(), F.format_string(K.RUN_COST, dollars("cost_usd"))).otherwise(""),
    )
    found = F.transform(F.coalesce("violations", F.array().cast("array<string>")), lambda v: F.format_string(K.RUN_VIOLATION, v))
    return runs.select("seed", F.posexplode(F.concat(F.array(head), found)).alias("line", "rendered"))


def render_run_totals(runs: DataFrame, budget: float) -> DataFrame:
    """``(line, rendered)``: false failures of calibrating runs, if there are any, and what was spent of the budget."""
    calibrating = F.col("mode") == "calibrate"
    totals = runs.agg(
        F.count_if(calibrating).alias("n"), F.count_if(calibrating & F.col("false_failure")).alias("bad"),
        F.sum(money("cost_usd")).alias("spent"), F.count("cost_usd").alias("steps"),
    )
    lines = F.array(
        F.struct(F.lit(1).alias("line"), F.when(F.col("n") > 0, F.format_string(K.FALSE_FAILURES, "bad", "n")).alias("rendered")),
        F.struct(F.lit(2).alias("line"), F.format_string(K.TOTAL_COST, dollars("spent"), dollars(F.lit(budget)), "steps").alias("rendered")),
    )
    return totals.select(F.inline(lines)).filter("rendered is not null")


def runs_json(runs: DataFrame) -> DataFrame:
    """``(seed, json)``: an object per run, with all of its columns."""
    return runs.select("seed", F.to_json(F.struct(*runs.columns)).alias("json"))


def render_suites(suites: DataFrame) -> DataFrame:
    """``(dir, line, rendered)``: a line per suite ``(dir, ok, summary, output)``; one that failed is followed by its output."""
    mark = F.when(F.col("ok"), "✅").otherwise("❌")
    lines = F.when(~F.col("ok") & (F.coalesce("output", F.lit("")) != ""), lines_of("output")).otherwise(F.array().cast("array<string>"))
    return suites.select("dir", F.posexplode(F.concat(F.array(F.format_string(K.SUITE_LINE, mark, "dir", "summary")), lines)).alias("line", "rendered"))


def render_lint_totals(violations: DataFrame) -> DataFrame:
    """``rendered``: errors and warnings of a lint run, zeros without any."""
    counts = violations.agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") != "error").alias("w"))
    return counts.select(F.format_string(K.LINT_COUNTS, "e", "w").alias("rendered"))
