"""Values of keys looked up for blocks of documents.

Documents are read in blocks of some megabytes.  A block numbers its distinct keys and keeps
for each document the numbers and frequencies of its keys.  Only the distinct keys of a block
travel: they are joined with a table of values, and the values go back to the block as
(number, value) rows.  So the shuffle carries a key once per block, not once per document,
and a key that every document has is one row per block.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import bounded, mapped, numbering, release_memory, written

BLOCK_BYTES = 32 << 20  # text of one block
PACKED_ROWS = 400_000  # values that travel back together
SCHEMA = "block long, number int, key string, kind int, weight long, extra long, documents binary"


def pack(value) -> bytes:
    raw = pickle.dumps(value, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes):
    return pickle.loads(pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))


def narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


class Numbering:
    """Numbers for the keys of a block, and per document (number, frequency) lists."""

    def __init__(self):
        self.number = numbering()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # keys per document, numbers, frequencies
        self.facts: list[dict[str, np.ndarray]] = []
        self.size = 0

    def add(self, keys: list[list], facts: dict[str, np.ndarray], size: int) -> None:
        """``keys``: the keys of each document in text order; ``facts``: further arrays, one value per document."""
        counts = np.fromiter(map(len, keys), np.int64, len(keys))
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(keys)), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(keys)), counts)
        pairs, times = np.unique(owner * (len(self.number) + 1) + numbers, return_counts=True)
        owner, numbers = np.divmod(pairs, len(self.number) + 1)
        self.parts.append((np.bincount(owner, minlength=len(keys)), numbers.astype(np.uint32), narrow(times)))
        self.facts.append(facts)
        self.size += size

    def all_facts(self) -> dict[str, np.ndarray]:
        return {k: np.concatenate([x[k] for x in self.facts]) for k in self.facts[0]}


class Ordered(Numbering):
    """Keeps the numbers of each document's keys in text order."""

    def add(self, keys: list[list], facts: dict[str, np.ndarray], size: int) -> None:
        counts = np.fromiter(map(len, keys), np.int64, len(keys))
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(keys)), np.uint32, int(counts.sum()))
        self.parts.append((counts, numbers, np.ones(len(numbers), np.uint8)))
        self.facts.append(facts)
        self.size += size


def planes(values: np.ndarray) -> list[np.ndarray]:
    """Bytes of 32-bit numbers, the lowest ones first, which compress better apart."""
    return [np.ascontiguousarray(x) for x in values.astype("<u4").view(np.uint8).reshape(-1, 4).T]


def whole_numbers(parts: list[np.ndarray]) -> np.ndarray:
    return np.stack(parts, axis=1).view("<u4").ravel()


@dataclass
class Closed:
    """What a block becomes: its keys, up to three numbers for each, and arrays about its documents."""

    keys: list[str]
    documents: dict
    kind: np.ndarray | None = None
    weight: np.ndarray | None = None
    extra: np.ndarray | None = None


def block_rows(block: int, closed: Closed) -> Iterator[pa.RecordBatch]:
    """Rows of one block: one with its documents, and one for each key."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = (pa.int32(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([
        pa.array([block], pa.int64()), pa.array([-1], pa.int32()), pa.nulls(1, pa.string()), *(pa.nulls(1, k) for k in kinds),
        pa.array([pack(closed.documents)], pa.binary()),
    ], names=names)
    for at in range(0, len(closed.keys), 100_000):
        part = closed.keys[at:at + 100_000]
        n = len(part)
        numbers = [pa.nulls(n, k) if v is None else pa.array(v[at:at + n], k) for k, v in zip(kinds, (closed.kind, closed.weight, closed.extra))]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(n, block)), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(part, pa.string()), *numbers, pa.nulls(n, pa.binary()),
        ], names=names)


def in_blocks(
    docs: DataFrame, add: Callable[[Numbering, pa.RecordBatch], None], close: Callable[[Numbering], Closed],
    purpose: str, block_bytes: int = BLOCK_BYTES, numbers: type[Numbering] = Numbering,
) -> DataFrame:
    """The table of blocks over ``docs`` (second column: the text), written to the shared folder.

    ``add`` puts a batch into a block; ``close`` ends a block; ``numbers`` keeps what a block has so far.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done = TaskContext.get().partitionId() << 32, 0
        block = numbers()
        for batch in bounded(batches):
            add(block, batch)
            if block.size >= block_bytes:
                yield from block_rows(first + done, close(block))
                block, done = numbers(), done + 1
                release_memory()
        if block.facts:
            yield from block_rows(first + done, close(block))

    return written(mapped(docs, SCHEMA, work), purpose)


def packed(values: DataFrame) -> DataFrame:
    """(block, number, values >= 0 ...) rows as few rows of arrays for each block."""
    width = len(values.columns)

    def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        block, number, *found = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(width))
        by = np.argsort(block, kind="stable")
        block, number, found = block[by], number[by].astype(np.uint32), [x[by] for x in found]
        edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        ends = np.append(edges[1:], len(block))
        blobs = [pack((number[a:b], *(narrow(x[a:b]) for x in found))) for a, b in zip(edges, ends)]
        return pa.RecordBatch.from_arrays([pa.array(block[edges]), pa.array(blobs, pa.binary())], names=["block", "values"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED_ROWS:
                yield rows(held)
                held, n = [], 0
        if n:
            yield rows(held)

    return mapped(values, "block long, values binary", work)


def back_to_blocks(blocks: DataFrame, values: DataFrame, schema: str, finish: Callable[..., pa.Table]) -> DataFrame:
    """Give each block its ``values`` (block, number, integers >= 0 ...).

    ``finish`` makes rows from the documents' arrays and, for each value column, an array by number.
    """
    width = len(values.columns) - 2

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        arrays = [unpack(x) for x in right.column("values").to_pylist()]
        by_number = [np.zeros(sum(len(x[0]) for x in arrays), np.int64) for _ in range(width)]
        for number, *found in arrays:
            for whole, part in zip(by_number, found):
                whole[number] = part
        return pa.concat_tables([finish(unpack(x), *by_number) for x in left.column("documents").to_pylist()])

    documents = blocks.where(F.col("number") < 0).select(F.col("block").alias("own_block"), "documents")
    return documents.groupBy("own_block").cogroup(packed(values).groupBy("block")).applyInArrow(work, schema)
