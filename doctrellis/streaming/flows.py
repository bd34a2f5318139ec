"""Structured Streaming forms: running totals, ordered budget gate, keyed upserts.

The gate and the upserts keep their state in Spark's state store: what a batch writes follows
the batch, and versions that are no longer needed are retired by Spark.
"""

from __future__ import annotations

from contextlib import contextmanager
from decimal import ROUND_HALF_UP, Decimal
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.values import money
from ..operators.trace import latest_per


def read_table_stream(spark: SparkSession, folder: str, name: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


def streaming_totals(costs: DataFrame, key: str, budget: float) -> DataFrame:
    """Totals per key as a streaming aggregate, with the overrun flag (strictly above).

    Partial sums are combined before the shuffle, so a busy key costs one row per task.
    """
    total = F.sum(money("cost_usd"))
    return costs.groupBy(key).agg(
        total.cast("double").alias("total_cost_usd"), F.count(F.lit(1)).alias("phases_run"),
        (total > F.lit(budget)).alias("overrun"),
    )


def windowed_totals(costs: DataFrame, key: str, ts: str, width: str, late: str) -> DataFrame:
    """Totals per key and time window; rows later than ``late`` are dropped by the watermark."""
    return (
        costs.withWatermark(ts, late).groupBy(key, F.window(ts, width).alias("w"))
        .agg(F.sum(money("cost_usd")).cast("double").alias("total_cost_usd"), F.count(F.lit(1)).alias("phases_run"))
        .select(key, F.col("w.start").alias("start"), "total_cost_usd", "phases_run")
    )


@contextmanager
def state_store(spark: SparkSession, retained: int):
    """Streams started inside keep their state in RocksDB: a batch writes a log of what it changed,
    and of the versions before it ``retained`` are kept."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.minBatchesToRetain": str(retained),
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class GateKey(StatefulProcessor):
    """Budget gate of one key over rows in any order.

    The state is the rows that the loop reaches, in order, the last one perhaps its stop; the
    budget and the number of steps bound it.  As costs aren't negative, a row that comes late
    moves the stop towards the start or leaves it where it is, so what lies behind a stop never
    has to be known again.
    """

    CHUNK = 10_000  # rows of a batch that are decided on together

    def __init__(self, state: str, result: list[str], keys: int, order: int, budget: int, estimate: int, max_steps: int | None):
        self.state, self.result, self.keys, self.order = state, result, keys, order
        self.budget, self.estimate, self.max_steps = budget, estimate, max_steps

    def init(self, handle) -> None:
        self.reached = handle.getListState("reached", self.state)
        self.revision = handle.getValueState("revision", "n long")

    def decide(self, rows: list[tuple]) -> int:
        """Give rows their status up to the first stop; how many are reached."""
        spent = 0
        for n, row in enumerate(rows):
            place, cost, blocked, failed = row[0], row[1], row[2], row[3]
            fits = self.budget - spent >= self.estimate and (self.max_steps is None or n < self.max_steps)
            spent += cost
            status = ("golden_missing" if blocked else "budget_skip" if not fits else "overrun" if spent > self.budget
                      else "invoke_error" if failed else "run")
            rows[n] = (place, cost, blocked, failed, status)
            if status != "run":
                return n + 1
        return len(rows)

    def handleInputRows(self, key, rows, timerValues):
        named = Row(*self.result)

        def row(place, status):
            return named(*key, *place, status, revision)

        rows = iter(rows)
        revision = self.revision.get()[0] + 1 if self.revision.exists() else 1
        kept = [(tuple(r[:self.order]), int(r[-4]), r[-3], r[-2], r[-1]) for r in self.reached.get()]
        told = {r[0]: r[4] for r in kept}
        while chunk := list(islice(rows, self.CHUNK)):
            fresh = {}
            for r in chunk:
                place, cost = tuple(r[self.keys:self.keys + self.order]), int(r[-3])
                if cost < 0:
                    raise ValueError(f"negative cost at {place}")
                if kept and kept[-1][4] != "run" and place > kept[-1][0]:
                    yield row(place, "not_reached")
                else:
                    fresh[place] = (place, cost, r[-2], r[-1])
            known = {r[0] for r in kept}
            merged = sorted([*kept, *(r for place, r in fresh.items() if place not in known)], key=lambda r: r[0])
            n = self.decide(merged)
            kept = merged[:n]
            for r in merged[n:]:
                yield row(r[0], "not_reached")
        for r in kept:
            if told.get(r[0]) != r[4]:
                yield row(r[0], r[4])
        self.reached.put([(*r[0], *r[1:]) for r in kept])
        self.revision.update((revision,))

    def close(self) -> None:
        pass


def gate_stream(
    costs: DataFrame, keys: list[str], order: list[str], budget: float, estimate: float, max_steps: int | None,
    path: str, checkpoint: str, failed: Column | None = None, blocked: Column | None = None, retained: int = 10, **trigger,
):
    """Budget gate over a stream whose rows may come in any order; starts it and returns the query.

    Keys hold their reached rows as state.  Each batch appends to ``path`` the rows whose status
    is new or has changed, with a revision that rises per key: ``gated`` gives the status that
    counts, which equals the batch gate's over all rows so far.  A row behind a stop is written
    once and kept nowhere else.  Order columns are not null and identify a row within its key; a
    place that comes again is the row that is there.  Costs are not negative (null: 0).
    """
    spark = costs.sparkSession
    rows = costs.select(
        *keys, *order, (F.coalesce(money("cost_usd"), F.lit(0)) * F.lit(1_000_000)).cast("bigint").alias("_cost"),
        F.coalesce(blocked if blocked is not None else F.lit(False), F.lit(False)).alias("_blocked"),
        F.coalesce(failed if failed is not None else F.lit(False), F.lit(False)).alias("_failed"),
    )
    place = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in order)
    told = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*keys, *order])
    micros = lambda x: int((Decimal(str(x)) * 1_000_000).to_integral_value(ROUND_HALF_UP))
    gate = GateKey(
        f"{place}, _cost bigint, _blocked boolean, _failed boolean, _status string", [*keys, *order, "status", "revision"],
        len(keys), len(order), micros(budget), micros(estimate), max_steps,
    )
    decided = rows.groupBy(*keys).transformWithState(
        statefulProcessor=gate, outputStructType=f"{told}, status string, revision long", outputMode="Append", timeMode="none",
    )
    with state_store(spark, retained):
        return (
            decided.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
        )


def gated(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, order, status) as of the last batch that ``gate_stream`` has written."""
    return latest_per(spark.read.parquet(path), [*keys, *order], ["revision"]).drop("revision")


def upsert_stream(changes: DataFrame, on: list[str], checkpoint: str, path: str | None = None, seq: str = "seq", retained: int = 10, **trigger):
    """Keep the newest row of each key as state; starts the stream and returns the query.

    The row with the highest ``seq`` wins whatever order batches arrive in; of equal ones the
    greatest, by its other columns.  It is a streaming maximum: rows of a key are combined before
    the shuffle, so a busy key costs one row per task, and a batch writes what it has changed.
    ``upserted`` reads the table.  With ``path`` each batch also leaves the newest rows of the
    keys that it had in ``path/batch=<n>``, and writes the same folder if it has to run again.
    """
    rest = [c for c in changes.columns if c not in on and c != seq]
    newest = changes.groupBy(*on).agg(F.max(F.struct(seq, *rest)).alias("newest"))

    def told(batch: DataFrame, number: int) -> None:
        batch.select(*on, "newest.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = newest.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(told) if path else writer.format("noop")
    with state_store(changes.sparkSession, retained):
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def upserted(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The table that ``upsert_stream`` keeps, as of its last batch."""
    with state_store(spark, 10):
        state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.*", "value.max.*")


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there and stop."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_batches(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that is there; keep the complete result of the last batch."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = (
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
        .outputMode("complete").trigger(availableNow=True).start()
    )
    query.awaitTermination()
