"""Quality classifier: boosted trees over document statistics.

Statistics come from the text alone.  Trees are fitted on at most ``MAX_LABELLED`` labelled
documents (the smallest by a hash of the id), which are looked up with a broadcast of that
bounded list; every document is scored, in one pass.

Null and empty texts have all statistics zero and get a score like any other; documents
without a label are scored too; rows with a null label or id teach nothing; repeated rows are
scored each; without labelled rows every score is 0.5.  Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .boosted_trees import Model, fit
from .common import bounded, mapped, numbering, utf8

MAX_LABELLED = 20_000

STATISTICS = (
    "log_chars log_words mean_word upper digits symbols punctuation exclamation pipes other non_ascii lines mean_line dup_lines "
    "distinct_words top_word short_words long_words repeated_triples entropy compressed upper_words ended_lines"
).split()


def members(characters: bytes) -> np.ndarray:
    table = np.zeros(256)
    table[list(characters)] = 1
    return table


CLASSES = np.stack([
    members(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), members(b"0123456789"), members(b"#*$%&<>@^~=+_\\/{}[]"), members(b".,;:?'\"()-"),
    members(b"!"), members(b"|"), members(b"\x00\x01\x02\x03\x04\x05\x06\x07\x08\x7f`"),
], axis=1)


def statistics(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    counts = np.zeros((n, 256))
    for i, raw in enumerate(texts):
        counts[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = counts.sum(axis=1)
    share = counts / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    words = [x.split() for x in texts]
    n_words = np.fromiter(map(len, words), np.int64, n)
    flat = list(chain.from_iterable(words))
    ids = np.fromiter(map(numbering().__getitem__, flat), np.int64, len(flat))
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    capital = np.fromiter((w[:2].isupper() for w in flat), bool, len(flat))
    owner = np.repeat(np.arange(n), n_words)
    top = int(ids.max(initial=0)) + 1
    pairs, times = np.unique(owner * top + ids, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, pairs // top, times)
    distinct = np.bincount(pairs // top, minlength=n)
    triples = np.zeros(n)
    if len(ids) > 2:
        inside = (owner[2:] == owner[:-2])
        mixed = (ids[:-2] * 1_000_003 + ids[1:-1]) * 1_000_003 + ids[2:]
        key = (mixed * 2_654_435_761 + owner[2:] * 40_503)[inside]
        _, where, times = np.unique(key, return_inverse=True, return_counts=True)
        triples = np.bincount(owner[2:][inside], weights=times[where] > 1, minlength=n)
    lines = [[y for y in x.split(b"\n") if y.strip()] for x in texts]
    n_lines = np.fromiter(map(len, lines), np.int64, n)
    per_word, per_line = np.maximum(n_words, 1), np.maximum(n_lines, 1)
    by_word = lambda values: np.bincount(owner, weights=values, minlength=n) / per_word
    return np.column_stack([
        np.log1p(size), np.log1p(n_words), by_word(lengths), share @ CLASSES, share[:, 128:].sum(axis=1),
        np.log1p(n_lines), np.log1p(size / per_line), np.fromiter((len(x) - len(set(x)) for x in lines), np.int64, n) / per_line,
        distinct / per_word, most / per_word, by_word(lengths <= 3), by_word(lengths >= 12), triples / per_word, entropy,
        np.fromiter((len(zlib.compress(x, 1)) for x in texts), np.int64, n) / np.maximum(size, 1), by_word(capital),
        np.fromiter((sum(y.rstrip()[-1:] in b".!?" for y in x) for x in lines), np.int64, n) / per_line,
    ])


def labelled_sample(labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn)
    picked = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    return picked.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int = MAX_LABELLED) -> Model:
    """Fit on the labelled documents for which ``learn`` (over doc_id) holds, ``most`` at most."""
    sample = labelled_sample(labels, label, learn, most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(sample), "doc_id").select("label", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            found = statistics(utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(found), pa.list_(pa.float64()))], names=["label", "statistics"])

    rows = mapped(joined, "label int, statistics array<double>", work).toArrow()  # ``most`` rows of two dozen numbers
    matrix = np.array(rows.column("statistics").to_pylist(), float).reshape(-1, len(STATISTICS))
    marks = np.array(rows.column("label").to_pylist(), float)
    order = np.lexsort((marks, *matrix.T))  # a fit doesn't hang on the order of tasks
    return fit(matrix[order], marks[order])


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the probability of label 1 of every row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            scores = model.probability(statistics(utf8(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, score double", work)
