"""Streaming runs over the event table: each drains the stream and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.discovery import work_folder
from ..operators.trace import latest_per
from ..streaming import flows
from .registry import query, table


_FILES = 5


def _events_table(spark, folder):
    return table(spark, folder, "events")


def _events(spark, folder):
    schema = _events_table(spark, folder).schema
    return flows.read_table_stream(spark, folder, "events", schema).withColumn("cost_usd", F.col("value"))


@query("stream_budget_totals", """
SELECT event_type, sum(CAST(value AS DECIMAL(28,6)))::DOUBLE AS total_cost_usd, count(*) AS phases_run,
 sum(CAST(value AS DECIMAL(28,6))) > 20000 AS overrun FROM events GROUP BY 1""")
def stream_budget_totals(spark, folder):
    work = work_folder(spark, "stream-totals")
    flows.run_batches(flows.streaming_totals(_events(spark, folder), "event_type", 20000.0), f"{work}/out", f"{work}/log")
    return spark.read.parquet(f"{work}/out")


def _in_disorder(spark, folder, work, *columns):
    """The events as a stream of several files, one a batch, each with rows of all times and users."""
    rows = _events_table(spark, folder).withColumn("_file", F.pmod(F.xxhash64("event_id"), F.lit(_FILES)))
    for n in range(_FILES):  # files are taken up in the order in which they were written
        rows.filter(F.col("_file") == n).select(*columns).coalesce(1).write.mode("append").parquet(f"{work}/in")
    files = spark.read.parquet(f"{work}/in")
    return spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/in")


_GATE = """
WITH s AS (SELECT event_id, user_id, ts, CAST(value AS DECIMAL(28,6)) AS c, event_type = 'error' AND value > 25 AS failed,
  coalesce(sum(CAST(value AS DECIMAL(28,6))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
o AS (SELECT *, CASE WHEN NOT (300 - before >= 8 AND n <= 40) THEN 'budget_skip' WHEN before + c > 300 THEN 'overrun'
  WHEN failed THEN 'invoke_error' ELSE 'run' END AS own FROM s),
r AS (SELECT *, coalesce(sum(CASE WHEN own <> 'run' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM o)
SELECT user_id, event_id, CASE WHEN stops = 0 THEN own ELSE 'not_reached' END AS status FROM r"""


@query("stream_budget_gate", _GATE)
def stream_budget_gate(spark, folder):
    """The gate over files in disorder; decisions are revised as earlier rows come in."""
    work = work_folder(spark, "stream-gate")
    rows = _in_disorder(spark, folder, work, "user_id", "ts", "event_id", "event_type", F.col("value").alias("cost_usd"))
    failed = (F.col("event_type") == "error") & (F.col("cost_usd") > 25)
    order = ["ts", "event_id"]
    flows.gate_stream(rows, ["user_id"], order, 300.0, 8.0, 40, f"{work}/rows", f"{work}/log", failed=failed).awaitTermination()
    return flows.gated(spark, f"{work}/rows", ["user_id"], order).select("user_id", "event_id", "status")


@query("stream_upsert", """
SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS seq FROM events GROUP BY 1""")
def stream_upsert(spark, folder):
    """The newest event of each user, from files in disorder."""
    work = work_folder(spark, "stream-upsert")
    changes = _in_disorder(spark, folder, work, "user_id", "event_type", F.col("event_id").alias("seq"))
    flows.upsert_stream(changes, ["user_id"], f"{work}/log").awaitTermination()
    return flows.upserted(spark, f"{work}/log").select("user_id", "event_type", "seq")


@query("stream_upsert_log", f"""
WITH f AS (SELECT * FROM events) SELECT user_id, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type FROM f GROUP BY 1""")
def stream_upsert_log(spark, folder):
    """The same table from what each batch says it has changed: the last batch with a user has the user's newest row."""
    work = work_folder(spark, "stream-upsert")
    changes = _in_disorder(spark, folder, work, "user_id", "event_type", F.col("event_id").alias("seq"))
    flows.upsert_stream(changes, ["user_id"], f"{work}/log", f"{work}/changes").awaitTermination()
    return latest_per(spark.read.parquet(f"{work}/changes"), ["user_id"], ["batch"]).select("user_id", "seq", "event_type")
