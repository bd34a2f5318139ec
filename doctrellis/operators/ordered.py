"""Ordered scans that hold up when one key owns a large share of the rows.

A window partitioned by a key puts all rows of that key into one task.  That is what
``ordered_scan`` does unless the caller asks for ``segments``: then rows are
range-partitioned on (key, order) into that many, so that a hot key is cut into consecutive
segments; each segment is scanned on its own and the values carried in from earlier
segments of the same key come from a table with at most two rows per segment boundary.
The caller decides because it knows its keys; nothing is measured while a plan is built.

The order columns must identify a row within its key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

@dataclass(frozen=True)
class RunningSum:
    """Sum of ``value`` (NULL counts as 0) up to the row, or up to the row before it."""

    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class LastValue:
    """Latest non-NULL ``value`` at or before the row (strictly before if not inclusive)."""

    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class NextValue:
    """Earliest non-NULL ``value`` at or after the row (strictly after if not inclusive)."""

    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class RowNumber:
    """1-based position of the row within its key."""


Scan = RunningSum | LastValue | NextValue | RowNumber


def Previous(value: Column) -> LastValue:
    """Value of the preceding row, NULL on the first row; NULL values are preserved."""
    return LastValue(F.struct(value.alias("v")), inclusive=False)


def Following(value: Column) -> NextValue:
    """Value of the following row, NULL on the last row; NULL values are preserved."""
    return NextValue(F.struct(value.alias("v")), inclusive=False)


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    scans: dict[str, Scan],
    segments: int | None = None,
) -> DataFrame:
    """Add one column per scan; ``segments`` cuts rows so that one key may own most of them."""
    return _plain(df, keys, order, scans) if segments is None else _segmented(df, keys, order, scans, segments)


def _unwrap(df: DataFrame, scans: dict[str, Scan]) -> DataFrame:
    """Open the one-field structs that ``Previous`` / ``Following`` wrap values in."""
    opened = {}
    for name, scan in scans.items():
        if isinstance(scan, (LastValue, NextValue)) and name in df.columns:
            dtype = df.schema[name].dataType
            if dtype.typeName() == "struct" and dtype.fieldNames() == ["v"]:
                opened[name] = F.col(f"`{name}`.v")
    return df.withColumns(opened) if opened else df


def _window_column(scan: Scan, keys: list[str], order: list[str]) -> Column:
    """The scan as a window over ``keys``.

    Looking ahead is looking back in descending order: a frame that starts at the row and
    ends with the group would be evaluated anew for every row.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    if isinstance(scan, RowNumber):
        return F.row_number().over(window).cast("bigint")
    if isinstance(scan, NextValue):
        window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    frame = window.rowsBetween(Window.unboundedPreceding, 0 if scan.inclusive else -1)
    if isinstance(scan, RunningSum):
        zero = F.lit(0).cast("int")
        return F.coalesce(F.sum(F.coalesce(scan.value, zero)).over(frame), zero)
    return F.last(scan.value, ignorenulls=True).over(frame)


def _plain(df, keys, order, scans):
    return _unwrap(
        df.withColumns({name: _window_column(scan, keys, order) for name, scan in scans.items()}), scans
    )


def _segmented(df, keys, order, scans, segments):
    values = {f"_v_{name}": s.value for name, s in scans.items() if not isinstance(s, RowNumber)}
    # Segment numbers come from sampled range bounds, so they are written down once:
    # both passes below must see the same cut.
    cut = cut_lineage(
        df.withColumns(values)
        .repartitionByRange(segments, *keys, *order)
        .withColumn("_segment", F.spark_partition_id())
    )

    totals = []
    position = F.struct(*order)
    for name, scan in scans.items():
        value = F.col(f"_v_{name}") if not isinstance(scan, RowNumber) else None
        if isinstance(scan, RunningSum):
            totals.append(F.sum(value).alias(f"_t_{name}"))
        elif isinstance(scan, LastValue):
            totals.append(F.max_by(value, F.when(value.isNotNull(), position)).alias(f"_t_{name}"))
        elif isinstance(scan, NextValue):
            totals.append(F.min_by(value, F.when(value.isNotNull(), position)).alias(f"_t_{name}"))
        else:
            totals.append(F.count(F.lit(1)).alias(f"_t_{name}"))
    per_segment = cut.groupBy(*keys, "_segment").agg(*totals)

    # Carries: only keys that cross a boundary have more than one row here, at most two
    # such keys per segment, whatever the size of the data.
    earlier = Window.unboundedPreceding, -1
    before = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(*earlier)
    after = Window.partitionBy(*keys).orderBy(F.col("_segment").desc()).rowsBetween(*earlier)
    carries = {}
    for name, scan in scans.items():
        total = F.col(f"_t_{name}")
        if isinstance(scan, LastValue):
            carries[f"_c_{name}"] = F.last(total, ignorenulls=True).over(before)
        elif isinstance(scan, NextValue):
            carries[f"_c_{name}"] = F.last(total, ignorenulls=True).over(after)
        else:
            carries[f"_c_{name}"] = F.sum(total).over(before)
    carry = (
        per_segment.withColumn("_parts", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        .filter("_parts > 1")
        .withColumns(carries)
        .select(*keys, "_segment", *carries)
    )
    carry = carry.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_segment").alias("_s"), *carries
    )

    local = cut.withColumns(
        {
            name: _window_column(
                scan if isinstance(scan, RowNumber) else type(scan)(F.col(f"_v_{name}"), scan.inclusive),
                [*keys, "_segment"], order,
            )
            for name, scan in scans.items()
        }
    )
    match = local["_segment"] == carry["_s"]
    for key in keys:
        match = match & local[key].eqNullSafe(carry[f"_k_{key}"])
    joined = local.join(carry, match, "left")
    result = {}
    for name, scan in scans.items():
        if isinstance(scan, (LastValue, NextValue)):
            result[name] = F.coalesce(F.col(name), F.col(f"_c_{name}"))
        else:
            result[name] = F.col(name) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))
    out = joined.select(*df.columns, *[c.alias(n) for n, c in result.items()])
    return _unwrap(out, scans)


def runs_of_equal(
    df: DataFrame, keys: list[str], order: list[str], value: str, run_col: str = "run_no", **kw
) -> DataFrame:
    """Number the runs of equal consecutive values (gaps and islands), from 1 per key."""
    stepped = ordered_scan(df, keys, order, {"_before": Previous(F.col(value)), "_n": RowNumber()}, **kw)
    changed = F.when(
        (F.col("_n") == 1) | ~F.col("_before").eqNullSafe(F.col(value)), F.lit(1)
    ).otherwise(F.lit(0))
    return ordered_scan(
        stepped.withColumn("_changed", changed), keys, order, {run_col: RunningSum(F.col("_changed"))}, **kw
    ).drop("_before", "_n", "_changed")


def until_first(
    df: DataFrame, keys: list[str], order: list[str], stop: Column, kept: str = "reached", **kw
) -> DataFrame:
    """Flag the rows a loop still reaches: all up to and including the first stop row."""
    flagged = df.withColumn("_stop", F.when(stop, F.lit(1)).otherwise(F.lit(0)))
    return (
        ordered_scan(flagged, keys, order, {"_stops": RunningSum(F.col("_stop"), inclusive=False)}, **kw)
        .withColumn(kept, F.col("_stops") == 0)
        .drop("_stop", "_stops")
    )
