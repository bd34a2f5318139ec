"""Merge and upsert operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import merge_maps
from ..operators import merge
from .registry import query, table

_OLD = "SELECT o_orderkey, o_custkey, o_orderstatus AS state FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'"
_NEW = "SELECT l_orderkey AS o_orderkey, max(l_suppkey) AS o_custkey, CASE WHEN max(l_returnflag) = 'R' THEN NULL ELSE 'upd' END AS state FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1"


def _old(spark, folder):
    return table(spark, folder, "orders").filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).select(
        "o_orderkey", "o_custkey", F.col("o_orderstatus").alias("state")
    )


def _new(spark, folder):
    return table(spark, folder, "lineitem").filter(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).groupBy(
        F.col("l_orderkey").alias("o_orderkey")
    ).agg(
        F.max("l_suppkey").alias("o_custkey"),
        F.when(F.max("l_returnflag") == "R", F.lit(None).cast("string")).otherwise("upd").alias("state"),
    )


@query("upsert_by_key", f"""
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(n.o_custkey, o.o_custkey) AS o_custkey, coalesce(n.state, o.state) AS state
FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.o_orderkey = n.o_orderkey""")
def upsert_by_key(spark, folder):
    return merge.upsert(_old(spark, folder), _new(spark, folder), ["o_orderkey"])


@query("upsert_rows", f"""
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_custkey ELSE o.o_custkey END AS o_custkey,
 CASE WHEN n.o_orderkey IS NOT NULL THEN n.state ELSE o.state END AS state
FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.o_orderkey = n.o_orderkey""")
def upsert_rows(spark, folder):
    return merge.upsert_rows(_old(spark, folder), _new(spark, folder), ["o_orderkey"])


@query("partial_update", f"""
SELECT * FROM ({_OLD}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_NEW})) UNION ALL SELECT * FROM ({_NEW})""")
def partial_update(spark, folder):
    return merge.replace_scope(_old(spark, folder), _new(spark, folder), ["o_orderkey"])


@query("create_if_absent", f"SELECT * FROM ({_NEW}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_OLD}))")
def create_if_absent(spark, folder):
    return merge.add_missing(_old(spark, folder), _new(spark, folder), ["o_orderkey"])


@query("map_merge", """
SELECT event_id, 'k=' || json_extract_string(props, '$.k') || CASE WHEN value > 10 THEN ',owner=new' ELSE ',owner=hand' END || CASE WHEN value > 10 THEN ',value=hi' ELSE '' END AS merged FROM events""")
def map_merge(spark, folder):
    """Extracted keys are overwritten, hand-written keys survive."""
    k = F.get_json_object("props", "$.k")
    old = F.create_map(F.lit("k"), F.lit("0"), F.lit("owner"), F.lit("hand"))
    new = F.when(F.col("value") > 10, F.create_map(F.lit("k"), k, F.lit("owner"), F.lit("new"), F.lit("value"), F.lit("hi"))).otherwise(
        F.create_map(F.lit("k"), k)
    )
    merged = F.array_sort(F.transform(F.map_entries(merge_maps(old, new)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return table(spark, folder, "events").select("event_id", F.array_join(merged, ",").alias("merged"))


@query("sync_classify", """
SELECT o_orderkey, CASE WHEN s IS NULL THEN 'copied' WHEN o_orderdate > s THEN 'updated' ELSE 'skipped' END AS action
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def sync_classify(spark, folder):
    """Copy new files, update when the source is newer, else skip; dates act as file times."""
    source = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").alias("mtime"))
    target = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("mtime"))
    return merge.sync_actions(source, target, on="o_orderkey")


@query("stale_paths", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48)")
def stale_paths(spark, folder):
    manifest = table(spark, folder, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 48").select(F.col("l_orderkey").alias("o_orderkey"))
    return merge.stale_paths(table(spark, folder, "orders").select("o_orderkey"), manifest, "o_orderkey")


@query("note_clearing", """
SELECT l_orderkey AS step, l_linenumber, l_partkey, l_returnflag = 'A' AS is_history FROM lineitem
WHERE l_returnflag = 'A' OR l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def note_clearing(spark, folder):
    """Notes of completed steps go, history rows stay."""
    notes = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("step"), "l_linenumber", "l_partkey", (F.col("l_returnflag") == "A").alias("is_history")
    )
    done = table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("step"))
    return merge.clear_notes(notes, done)
