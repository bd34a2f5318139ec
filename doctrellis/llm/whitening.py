"""Whitening of embeddings by the leading components of their covariance.

Vectors become integers, x = floor(64 * entry) + 1000000, in blocks that are written once.
Sums and the squared deviation are exact.  Components come from block Jacobi-Davidson, which
asks for products of the covariance with a few columns only: a product is a pass over the
blocks, each centred before it is multiplied, with partial sums added up in Spark piece by
piece, so that neither the covariance nor more than one product gets to the driver.

Rows whose vector is null, empty or holds a null or non-finite entry are left out, and so are
vectors of another length than most have (of several such lengths, the smallest).  Entries
beyond 2**46 in size count as that.  Repeated rows count each and are returned each, with null
ids too.  Components of no variance (at rounding: fewer rows than dimensions, equal vectors)
are none; an empty table, or one of equal vectors, gives an empty table.  ``deviation`` is null
where it is beyond a long; ``deviation_exact`` has 38 digits.  Only ``vec_id`` and
``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import mapped, written
from .jacobi_davidson import largest

COMPONENTS = 32
STEP, SHIFT = 64, 1_000_000
FURTHEST = float(1 << 52)  # of STEP * entry
ROWS = 8192  # of a block
PIECES = 8  # of a sum, added up apart
LIMB = 26  # bits of the lower part in exact sums
BLOCKS = "dimension int, ids binary, missing binary, x binary, kind string"
RESULT = "vec_id long, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double"


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks of vectors of one length, as the smallest integers that hold floor(STEP * entry)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield from cut(batch.slice(at, ROWS))

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(1)
        flat, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        good = np.bincount(owner, weights=~np.isfinite(values), minlength=len(sizes)) == 0
        ids = batch.column(0).fill_null(0).to_numpy()
        missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        for d in np.unique(sizes[good & (sizes > 0)]).tolist():
            own = good & (sizes == d)
            x = np.floor(np.clip(STEP * values[own[owner]], -FURTHEST, FURTHEST)).astype(np.int64)
            kind = np.promote_types(np.min_scalar_type(int(x.min())), np.min_scalar_type(int(x.max())))
            kind = kind if kind.kind == "i" else np.promote_types(kind, np.int8)
            yield pa.RecordBatch.from_arrays([
                pa.array([d], pa.int32()), pa.array([ids[own].tobytes()]), pa.array([missing[own].tobytes()]), pa.array([x.astype(kind).tobytes()]), pa.array([kind.str]),
            ], names=["dimension", "ids", "missing", "x", "kind"])

    return written(mapped(rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")), BLOCKS, work), "vectors")


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, which ids are null, vectors) of each block."""
    for batch in batches:
        for d, ids, missing, x, kind in zip(*(batch.column(c).to_pylist() for c in range(5))):
            yield np.frombuffer(ids, np.int64), np.frombuffer(missing, bool), np.frombuffer(x, kind).reshape(-1, d)


def total(vectors: DataFrame, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray], kind: type = float) -> np.ndarray:
    """Sum over all blocks of ``part`` (of ``shape``): added up in tasks, then piece by piece, then put together."""
    size = shape[0] * shape[1]
    edges = np.linspace(0, size, min(PIECES, size) + 1).astype(int)
    schema = "piece int, amounts binary"

    def batch(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["piece", "amounts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        amount = np.zeros(shape, kind)
        for _, _, x in matrices(batches):
            amount += part(x)
        flat = amount.ravel()
        yield batch({i: flat[a:b] for i, (a, b) in enumerate(zip(edges, edges[1:]))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for rows in batches:
            for i, blob in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(blob, kind)
        if sums:
            yield batch(sums)

    whole = np.zeros(size, kind)
    for row in mapped(mapped(vectors, schema, count).repartition("piece"), schema, add).collect():  # one product in all
        whole[edges[row["piece"]]:edges[row["piece"] + 1]] = np.frombuffer(row["amounts"], kind)
    return whole.reshape(shape)


def exact_sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows, and the sum of each dimension, in two limbs so that no long runs over."""
    def part(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64)
        return np.stack([np.append((x >> LIMB).sum(axis=0), len(x)), np.append((x & (1 << LIMB) - 1).sum(axis=0), 0)])

    high, low = total(vectors, (2, d + 1), part, np.int64).tolist()
    return high[-1], [(a << LIMB) + b for a, b in zip(high[:-1], low[:-1])]


class Centre:
    """Subtracts the mean of n vectors with these sums, without rounding the mean first."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.floor = np.array([s // n for s in sums], np.int64)
        self.over = np.array([s % n / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor).astype(float) - self.over

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - sum)^2 of each vector."""
        away = x - self.floor
        rest = [s % self.n for s in self.sums]
        most = self.n * int(np.abs(away).max(initial=0)) + self.n
        if most * most * len(self.sums) < 1 << 63:
            return ((self.n * away - np.array(rest)) ** 2).sum(axis=1).tolist()
        return [sum((self.n * a - r) ** 2 for a, r in zip(row, rest)) for row in away.tolist()]


def components(spark: SparkSession, vectors: DataFrame, d: int, centre: Centre, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, eigenvectors as columns, trace) of the covariance; only eigenvalues above rounding."""
    n = centre.n
    trace = float(total(vectors, (1, 1), lambda x: np.array([[(centre(x) ** 2).sum()]]))[0, 0]) / n

    def product(block: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(block)  # dimension x columns
        found = total(vectors, block.shape, lambda x: (c := centre(x)).T @ (c @ sent.value)) / n
        sent.destroy()
        return found

    values, found = largest(product, d, min(wanted, d))
    there = values > d * np.finfo(float).eps * max(values[0], trace)
    found = found[:, there] * np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])[there]
    return values[there], found, trace


def whitened(rows: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    vectors = blocks(rows)
    sizes = vectors.groupBy("dimension").agg(F.expr("sum(length(ids) div 8)").alias("rows"))
    usual = sizes.orderBy(F.desc("rows"), "dimension").first()
    if usual is None:
        return spark.createDataFrame([], RESULT)
    d = usual["dimension"]
    vectors = vectors.where(F.col("dimension") == d)
    centre = Centre(*exact_sums(vectors, d))
    values, found, trace = components(spark, vectors, d, centre, wanted)
    k = len(values)
    if not k:
        return spark.createDataFrame([], RESULT)
    turn, explained, n = found / np.sqrt(values), values / trace, centre.n

    def moments(x: np.ndarray) -> np.ndarray:
        z = np.concatenate([centre(x) @ turn, np.ones((len(x), 1))], axis=1)
        return z.T @ z

    sums = total(vectors, (k + 1, k + 1), moments) / n
    error = float(np.abs(sums[:k, :k] - np.outer(sums[:k, k], sums[:k, k]) - np.eye(k)).max())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, missing, x in matrices(batches):
            for at in range(0, len(ids), 2048):
                part = x[at:at + 2048]
                exact = centre.deviations(part)
                each = np.repeat(np.arange(len(part)), k)
                narrow = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
                wide = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[at:at + 2048][each], mask=missing[at:at + 2048][each]), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                    pa.array(np.full(len(each), n)), narrow.take(pa.array(each)), wide.take(pa.array(each)), pa.array((centre(part) @ turn).ravel()),
                    pa.array(np.tile(explained, len(part))), pa.array(np.full(len(each), error)),
                ], names=[c.split()[0] for c in RESULT.split(", ")])

    return mapped(vectors, RESULT, work)
