"""Keyed merges, mirrors and synchronisation decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trace import distinct_keys, latest_per


def upsert(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Full outer merge, field by field: a new value wins, a new NULL keeps the old one.

    Both sides hold one row per key.
    """
    values = [c for c in old.columns if c not in on]
    joined = old.alias("o").join(new.alias("n"), on, "full_outer")
    return joined.select(*on, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in values])


def upsert_rows(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Whole-row upsert as one aggregate: union, then the newer row per key."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    return latest_per(both, on, ["_age"]).drop("_age").select(*old.columns)


def replace_scope(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """Partial update: scopes present in ``new`` are replaced, all others are retained."""
    return old.join(distinct_keys(new, *scope), scope, "left_anti").select(*old.columns).unionByName(
        new.select(*old.columns)
    )


def add_missing(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Rows to create: only keys that do not exist yet."""
    return new.join(distinct_keys(old, *on), on, "left_anti")


def sync_actions(source: DataFrame, target: DataFrame, on: str = "path", mtime: str = "mtime") -> DataFrame:
    """``copied`` / ``updated`` / ``skipped`` per source file (updated only if strictly newer)."""
    there = target.select(on, F.col(mtime).alias("_there"))
    return source.join(there, on, "left").select(
        on,
        F.when(F.col("_there").isNull(), "copied")
        .when(F.col(mtime) > F.col("_there"), "updated")
        .otherwise("skipped")
        .alias("action"),
    )


def stale_paths(existing: DataFrame, manifest: DataFrame, on: str = "path") -> DataFrame:
    """Existing paths that a removal manifest lists."""
    return existing.join(distinct_keys(manifest, on), on, "left_semi")


def clear_notes(notes: DataFrame, completed: DataFrame, step: str = "step") -> DataFrame:
    """Notes that stay: history rows always, the others while their step is not complete."""
    done = distinct_keys(completed, step).withColumn("_done", F.lit(True))
    return notes.join(done, step, "left").filter(F.col("is_history") | F.col("_done").isNull()).drop("_done")


def repo_outcome(results: DataFrame, overall: str = "ALL") -> DataFrame:
    """Success per repository and overall; one failure keeps the whole from succeeding."""
    per_repo = results.groupBy("repo").agg(
        F.bool_and("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failures")
    )
    whole = results.agg(
        F.lit(overall).alias("repo"), F.bool_and("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failures")
    )
    return per_repo.unionByName(whole)


def next_revision(existing: DataFrame, keys: list[str], revision: str = "revision") -> DataFrame:
    """The number the next revision of each key gets."""
    return existing.groupBy(*keys).agg((F.max(revision) + 1).alias("next_revision"))


def tenth_revision(existing: DataFrame, keys: list[str], revision: str = "revision") -> DataFrame:
    """Next revision of documents that count in tenths; decimals, so that nine tenths go on to one."""
    tenths = F.max(F.col(revision).cast("decimal(18,1)")) + F.lit("0.1").cast("decimal(2,1)")
    return existing.groupBy(*keys).agg(tenths.cast("decimal(18,1)").alias("next_revision"))


def next_run(existing: DataFrame, keys: list[str], run: str = "run") -> DataFrame:
    """Next run label of each key: two digits, more when they are needed."""
    number = (F.max(run) + 1).cast("string")
    return existing.groupBy(*keys).agg(F.concat(F.lit("run "), F.lpad(number, F.greatest(F.lit(2), F.length(number)), F.lit("0"))).alias("next_run"))


def emptied_folders(existing: DataFrame, removed: DataFrame, folders: DataFrame, on: str = "path", folder: str = "folder") -> DataFrame:
    """Listed folders that hold no file once ``removed`` is gone; others stay."""
    left = existing.join(distinct_keys(removed, on), on, "left_anti").select(folder)
    return folders.select(folder).distinct().join(left.distinct(), folder, "left_anti")
