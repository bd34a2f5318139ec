"""Token counts without token ids.

A tokenizer with white-space-free pre-tokens treats each pre-token for itself, so a document
has as many tokens as its pre-tokens have pieces.  Pieces are counted once per distinct
pre-token of the corpus and joined to the pre-token frequencies of each document (in blocks,
see ``blocks``); the sum over a document is its token count.

Null and empty texts have no tokens; repeated rows and null ids are counted row by row; an
empty table gives an empty table; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .blocks import Closed, Numbering, back_to_blocks, in_blocks, narrow
from .common import mapped, numbering, utf8

LIMIT = 2048
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pretokens(tokenizer, specials: tuple[str, ...], chunk: str) -> list[str]:
    """Pre-tokens of a text between ASCII white space, as the model sees them.

    A text that holds a special string stays whole, marked with a leading space.
    """
    if chunk.isascii() and chunk.isalpha():
        return [chunk.lower()]
    if any(s in chunk for s in specials):
        return [" " + chunk]
    return [x for x, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(chunk))]


def spread_chunks(counts: np.ndarray, numbers: np.ndarray, times: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per-document frequencies of chunks as those of the pre-tokens (``flat``, ``sizes`` per chunk) they fall into."""
    starts = np.cumsum(sizes) - sizes
    each = sizes[numbers]
    at = np.repeat(starts[numbers], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    owner = np.repeat(np.repeat(np.arange(len(counts)), counts), each)
    pairs, where = np.unique(owner * (len(flat) + 1) + flat[at], return_inverse=True)
    summed = np.bincount(where, weights=np.repeat(times, each), minlength=len(pairs)).astype(np.int64)
    owner, found = np.divmod(pairs, len(flat) + 1)
    return np.bincount(owner, minlength=len(counts)).astype(np.uint32), found.astype(np.uint32), narrow(summed)


def pretoken_blocks(docs: DataFrame, path: str) -> DataFrame:
    """Blocks of documents with the frequencies of their pre-tokens."""
    loaded = []

    def add(block: Numbering, batch: pa.RecordBatch) -> None:
        texts = utf8(batch.column(1))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        block.add([x.split() for x in texts], {"doc_id": np.array(batch.column(0).to_pylist(), object), "n_bytes": sizes}, int(sizes.sum()))

    def close(block: Numbering):
        if not loaded:
            tokenizer = load(path)
            loaded.extend((tokenizer, tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())))
        number, flat, sizes = numbering(), array("i"), array("i")
        for chunk in block.number:
            found = pretokens(*loaded, chunk.decode())
            flat.extend(map(number.__getitem__, found))
            sizes.append(len(found))
        block.number.clear()
        sizes, flat = np.array(sizes, np.int64), np.array(flat, np.int64)
        spread = [spread_chunks(*x, sizes, flat) for x in block.parts]
        block.parts.clear()
        counts, numbers, times = (np.concatenate([x[i] for x in spread]) for i in range(3))
        return Closed(list(number), block.all_facts() | {"counts": counts, "numbers": numbers, "times": times})

    return in_blocks(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), add, close, "pretokens")


def pieces(keys: DataFrame, path: str) -> DataFrame:
    """(block, number, value): the pieces of each pre-token, counted once per distinct one.

    ``keys`` (block, number, key) are brought together by key, so a task meets each of its
    pre-tokens as one run of rows.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, last = load(path), (None, 0)
        for batch in batches:
            runs = pc.run_end_encode(batch.column(2))
            counts = []
            for k in runs.values.to_pylist():
                if k != last[0]:  # a run may go on from the batch before
                    last = k, len(tokenizer.encode(k[1:], add_special_tokens=False).ids if k[:1] == " " else tokenizer.model.tokenize(k))
                counts.append(last[1])
            ends = runs.run_ends.to_numpy()
            values = np.repeat(np.array(counts, np.int64), np.diff(ends, prepend=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], names=["block", "number", "value"])

    return mapped(keys.repartition("key").sortWithinPartitions("key"), "block long, number int, value long", work)


def sums(documents: dict, value: np.ndarray, limit: int) -> pa.Table:
    counts = documents["counts"].astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    total = np.bincount(owner, weights=value[documents["numbers"]] * documents["times"].astype(np.int64), minlength=len(counts)).astype(np.int64)
    return pa.table({
        "doc_id": pa.array(documents["doc_id"], pa.int64()), "n_bytes": pa.array(documents["n_bytes"]),
        "n_tokens": pa.array(total), "over_limit": pa.array(total > limit),
    })


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per row: bytes, tokens under the tokenizer file ``path``, and whether they exceed ``limit``."""
    blocks = pretoken_blocks(docs, path)
    values = pieces(blocks.where(F.col("number") >= 0).select("block", "number", "key"), path)
    return back_to_blocks(blocks, values, SCHEMA, lambda documents, value: sums(documents, value, limit))
