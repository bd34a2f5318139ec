"""Small pieces that several operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import count

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

BATCH_BYTES = 4 << 20  # texts that one step of a task handles together; a longer text is a step of its own


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: made once, and no lost executor has to make it again."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of ``column`` stay below ``limit`` bytes, or are one row."""
    for batch in batches:
        start = size = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def mapped(df: DataFrame, schema: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` over ``df``; ``work`` gets and gives record batches."""
    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release_memory()

    return df.mapInArrow(trimmed, schema)


def release_memory() -> None:
    """Give freed memory back to the system: Python workers live on and serve other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [v if v is not None else b"" for v in column.cast(pa.binary()).to_pylist()]


class Shared:
    """A broadcast object of this package: it goes out by value, so executors need no repository."""

    def __init__(self, spark: SparkSession, value):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @cached_property
    def value(self):
        return cloudpickle.loads(self.sent.value)

    def __getstate__(self):
        return {"sent": self.sent}


def numbering() -> defaultdict:
    """Numbers keys in the order they are first asked for."""
    return defaultdict(count().__next__)


def crc_fold(column: str, modulus: int):
    """crc32 of a number written as decimal text, modulo ``modulus``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)
