"""Traceability: requirement, design and test rows joined, counted and reconciled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def distinct_keys(df: DataFrame, *columns: str) -> DataFrame:
    """Existence side of a semi or anti join: pre-aggregated, so no key is hot on it."""
    return df.select(*columns).distinct()


def missing_from(required: DataFrame, covered: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``required`` without a counterpart (coverage gap, dangling reference)."""
    return required.join(distinct_keys(covered, *on), on, "left_anti")


def explode_ids(rows: DataFrame, cell: str, out: str = "sp_id") -> DataFrame:
    """One row per id of a comma-separated cell."""
    ids = F.filter(F.transform(F.split(cell, "[,、，]"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.withColumn(out, F.explode(ids))


def traceability_rows(table_rows: DataFrame, requirement: str = "要求ID", child: str = "子", spec: str = "仕様ID") -> DataFrame:
    """``(path, line, ur_id, sr_id, sp_id)`` from matrix tables in either column layout.

    Columns are found by header text: the first requirement column is the parent, a
    requirement column whose header names the child is optional.
    """
    def column_at(test) -> Column:
        at = F.array_position(F.transform("header", test), True)
        return F.when(at > 0, F.element_at("cells", F.when(at > 0, at).cast("int")))

    body = table_rows.filter(
        F.exists("header", lambda h: F.contains(h, F.lit(spec)))
        & F.exists("header", lambda h: F.contains(h, F.lit(requirement)))
        & (F.col("line") > F.col("table_line")) & ~F.col("is_separator")
        & (F.size("cells") == F.size("header"))
    )
    rows = body.select(
        "path", "line",
        column_at(lambda h: F.contains(h, F.lit(requirement)) & ~F.contains(h, F.lit(child))).alias("ur_id"),
        column_at(lambda h: F.contains(h, F.lit(requirement)) & F.contains(h, F.lit(child))).alias("sr_id"),
        column_at(lambda h: F.contains(h, F.lit(spec))).alias("_sp"),
    )
    return explode_ids(rows, "_sp").select("path", "line", "ur_id", "sr_id", "sp_id")


def unique_candidate(rows: DataFrame, candidates: DataFrame, on: str, value: str) -> DataFrame:
    """Fill ``value`` only when exactly one distinct candidate exists.

    Adds ``n_candidates`` and ``value`` (NULL for none or several: those stay unresolved).
    Minimum and maximum tell "one distinct value" apart without collecting the values.
    """
    counted = candidates.groupBy(on).agg(
        F.countDistinct(value).alias("n_candidates"), F.min(value).alias("_only")
    )
    return (
        rows.join(counted, on, "left")
        .withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
        .withColumn(value, F.when(F.col("n_candidates") == 1, F.col("_only")))
        .drop("_only")
    )


def shared_targets(rows: DataFrame, target: str, owner: str) -> DataFrame:
    """Owners that meet on a target: one row per (target, owner) with ``n_owners`` >= 2.

    Stays linear in the input: the pairs of a collision follow from the rows that share a
    target and are never written out.
    """
    pairs = distinct_keys(rows, target, owner)
    crowded = pairs.groupBy(target).agg(F.count(F.lit(1)).alias("n_owners")).filter("n_owners > 1")
    return pairs.join(crowded, target).select(target, owner, "n_owners")


def reconcile(left: DataFrame, right: DataFrame, on: list[str], values: list[str] | None = None) -> DataFrame:
    """Full outer comparison: ``status`` is ``added``, ``removed``, ``changed`` or ``same``."""
    values = values or []
    a = left.select(*on, F.struct(F.lit(1).alias("_in"), *values).alias("_a"))
    b = right.select(*on, F.struct(F.lit(1).alias("_in"), *values).alias("_b"))
    return a.join(b, on, "full_outer").select(
        *on,
        F.when(F.col("_a").isNull(), "added")
        .when(F.col("_b").isNull(), "removed")
        .when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
        .otherwise("same")
        .alias("status"),
    )


def childless(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents with fewer than one child."""
    return parents.join(
        distinct_keys(children.withColumnRenamed(child_key, parent_key), parent_key), parent_key, "left_anti"
    )


def duplicates(rows: DataFrame, key: Column | str, member: str, out: str = "key") -> DataFrame:
    """Keys that occur more than once, with their count and smallest member."""
    key = F.col(key) if isinstance(key, str) else key
    return rows.groupBy(key.alias(out)).agg(
        F.count(F.lit(1)).alias("n"), F.min(member).alias("first_member")
    ).filter("n > 1")


def tally(rows: DataFrame, status: str, statuses: DataFrame | None = None) -> DataFrame:
    """Histogram with a ``TOTAL`` row; ``statuses`` keeps values that never occur."""
    counted = rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    if statuses is not None:
        counted = statuses.select(status).distinct().join(counted, status, "left").select(
            status, F.coalesce("n", F.lit(0)).alias("n")
        )
    total = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("TOTAL").alias(status), "n")
    return counted.unionByName(total)


def tally_matches(rows: DataFrame, stated: DataFrame, keys: list[str], status: str) -> DataFrame:
    """Recount results and compare with the counts a report states."""
    counted = rows.groupBy(*keys, status).agg(F.count(F.lit(1)).alias("counted"))
    return stated.join(counted, [*keys, status], "full_outer").select(
        *keys, status, F.coalesce("stated", F.lit(0)).alias("stated"),
        F.coalesce("counted", F.lit(0)).alias("counted"),
        (F.coalesce("stated", F.lit(0)) == F.coalesce("counted", F.lit(0))).alias("agrees"),
    )


def coverage(rows: DataFrame, keys: list[str], covered: Column, threshold: int = K.COVERAGE_THRESHOLD) -> DataFrame:
    """Total, covered, uncovered, percentage and the gate (at or above the threshold)."""
    total, hit = F.count(F.lit(1)), F.count_if(covered)
    percent = F.round(hit * F.lit(100.0) / total, 2)
    return rows.groupBy(*keys).agg(
        total.alias("total"), hit.alias("covered"), (total - hit).alias("uncovered"),
        percent.alias("percent"), (hit * 100 >= total * threshold).alias("passes"),
    )


def posting_lists(rows: DataFrame, tag: str, member: str, numbered: DataFrame, size: int) -> DataFrame:
    """Inverted index in blocks of at most ``size`` members, so no tag is one long string.

    ``numbered`` is ``rows`` with a 1-based ``n`` per tag in member order.
    """
    block = F.floor((F.col("n") - 1) / size).cast("bigint")
    return numbered.groupBy(tag, block.alias("block")).agg(
        F.count(F.lit(1)).alias("members"),
        F.array_join(F.array_sort(F.collect_list(F.col(member))).cast("array<string>"), ",").alias("ids"),
    )


def with_empty_tags(index: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """Every known tag appears; one without members shows a dash.

    Only the distinct tags are compared; posting lists stay where they are.
    """
    empty = tags.select(tag).distinct().join(index.select(tag).distinct(), tag, "left_anti").select(
        tag, F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("members"), F.lit("—").alias("ids"),
    )
    return index.select(tag, "block", "members", "ids").unionByName(empty)


def crosstab(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and a fixed list of column values, with a total; absent means 0."""
    return rows.groupBy(row).agg(
        *[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values],
        F.count_if(F.col(column).isin(*values)).alias("n_total"),
    )


def access_matrix(rows: DataFrame, process: str, entity: str, operation: str, letters: str = "CRUD") -> DataFrame:
    """``(process, entity, ops)`` with the letters of all sources merged in fixed order."""
    flags = rows.groupBy(process, entity).agg(
        *[F.bool_or(F.col(operation) == x).alias(f"_{x}") for x in letters]
    )
    return flags.select(
        process, entity,
        F.concat_ws("", *[F.when(F.col(f"_{x}"), F.lit(x)) for x in letters]).alias("ops"),
    )


def scale_warnings(counts: DataFrame, keys: list[str], limits: dict[str, int] = K.SCALE_LIMITS) -> DataFrame:
    """``(keys..., kind, n, limit)`` where a count is strictly above its limit.

    ``counts`` is long: keys, ``kind``, ``n``.
    """
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return counts.withColumn("limit", F.try_element_at(limit, F.col("kind"))).filter("n > limit").select(
        *keys, "kind", "n", "limit"
    )


def deprecated_modules(documented: DataFrame, surveyed: DataFrame, reserved: list[str], protected: DataFrame) -> DataFrame:
    """Documented modules nobody surveyed, minus reserved names and protected ones."""
    on = ["repo", "module"]
    return (
        documented.filter(~F.col("module").isin(*reserved))
        .join(distinct_keys(surveyed, *on), on, "left_anti")
        .join(distinct_keys(protected, *on), on, "left_anti")
    )


def route(items: DataFrame, destinations: DataFrame, on: str, destination: str, unknown: str) -> DataFrame:
    """Destination by dimension lookup; items without one go to the ``unknown`` list."""
    return items.join(destinations.select(on, destination), on, "left").withColumn(
        destination, F.coalesce(destination, F.lit(unknown))
    )


def large_change(old: Column, new: Column, ratio: float = K.TEXT_CHANGE_RATIO) -> Column:
    """Whether a size moved by strictly more than ``ratio`` of the old size."""
    return F.when(old > 0, F.abs(new - old) > old * F.lit(ratio)).otherwise(new > 0)


def forced_two_layers(sub_requirements: DataFrame, group: str = "group_id") -> DataFrame:
    """Lone sub-requirements of a group that still carry a reason or an explanation.

    The group is counted first and joined back, so no window has to hold a whole group.
    """
    lone = sub_requirements.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(group)
    filled = (F.coalesce(F.trim("reason"), F.lit("")) != "") | (F.coalesce(F.trim("explanation"), F.lit("")) != "")
    return sub_requirements.join(lone, group, "left_semi").filter(filled)


def latest_per(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row with the highest version per key (an aggregate, combined before the shuffle)."""
    others = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*version))
    return rows.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def first_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key in the given total order."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def top_per(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key; Spark limits each map-side group before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def graph_changed(old_nodes: Column, new_nodes: Column, old_edges: Column, new_edges: Column) -> Column:
    """A diagram changed in size: another number of nodes or edges."""
    return ~(old_nodes.eqNullSafe(new_nodes) & old_edges.eqNullSafe(new_edges))


def route_by_rules(items: DataFrame, rules: DataFrame, step: str, conditions: list[str], destination: str, unknown: str) -> DataFrame:
    """Destination by step and conditions; a rule that leaves a condition open (NULL) takes any value.

    Of several fitting rules the one with the most conditions counts (then the smallest
    destination); items without one go to the ``unknown`` list.  Items are matched once per
    combination that occurs, so rules and combinations meet, not rules and items.
    """
    by = [step, *conditions]
    kinds = items.select(*[F.col(c).alias(f"_item_{c}") for c in by]).distinct()
    given = rules.select(*[F.col(c).alias(f"_rule_{c}") for c in by], F.col(destination).alias("_to"))
    fits = F.col(f"_item_{step}") == F.col(f"_rule_{step}")
    for c in conditions:
        fits = fits & (F.col(f"_rule_{c}").isNull() | (F.col(f"_rule_{c}") == F.col(f"_item_{c}")))
    strength = F.size(F.array_compact(F.array(*[F.col(f"_rule_{c}").cast("string") for c in conditions])))
    best = kinds.join(given, fits).groupBy(*kinds.columns).agg(F.min_by("_to", F.struct(-strength, F.col("_to"))).alias("_best"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_item_{c}"))
    return items.join(best, same, "left").select(*items.columns, F.coalesce("_best", F.lit(unknown)).alias(destination))


def chain_gaps(done: DataFrame, chain: DataFrame, keys: list[str], phase: str = "phase", position: str = "position") -> DataFrame:
    """Phases of a strict chain that a key skipped: before its furthest phase, and not done."""
    placed = done.join(chain.select(phase, position), phase)
    furthest = placed.groupBy(*keys).agg(F.max(position).alias("_furthest"), F.collect_set(position).alias("_done"))
    return furthest.select(*keys, "_done", F.explode(F.sequence(F.lit(1), F.col("_furthest"))).alias(position)).filter(
        ~F.array_contains("_done", F.col(position))
    ).drop("_done").join(chain.select(phase, position), position).select(*keys, phase)


def review_brief(rows: DataFrame, keys: list[str], order: list[Column], n: int, size: str, per_minute: int) -> DataFrame:
    """The first ``n`` rows per key with their place in the reading order, minutes, and minutes so far."""
    window = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return top_per(rows, keys, order, n).withColumn("minutes", F.ceil(F.col(size) / per_minute).cast("bigint")).withColumn(
        "minutes_so_far", F.sum("minutes").over(window)
    )
