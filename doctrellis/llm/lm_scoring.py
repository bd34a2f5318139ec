"""Scores of documents under a context-mixing language model of the corpus.

Texts are sequences of words (A-Z lower-cased) and one end.  Every document has a kind, a hash
class of its most frequent word, which the model is told first.  The corpus is gathered as
counts of (kind, word) over all training documents, and in each block of documents as counts
of word heads with the bytes before them (see ``context_mixing``).  The hashed tables of the
bit predictors are trained from these counts, each task on its share, and added up; the mixer
learns online from a part of the training documents that the tables don't hold at that time.
What follows a word's head is scored once per distinct (kind, word), and scores go back to the
blocks that asked for them (see ``blocks``).  A block keeps its words in text order, so it
scores heads after the bytes that stand before them in their text, and sums both.

Beside the model's score stands a plain one: add-one smoothed word frequencies.

Null and empty texts are the end alone; repeated rows are counted and scored each; rows with a
null id are scored but teach nothing; an empty table gives an empty table; without training
documents every frequency is zero.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .blocks import Closed, Ordered, back_to_blocks, in_blocks, narrow, pack, planes, unpack, whole_numbers
from .common import mapped, utf8, written
from .context_mixing import A, BUCKETS, CELLS, GATES, HEAD, KINDS, WIDTH, Counts, Heads, Mixer, before_words, edges, head_keys, heads, log_odds

FOLDS, HELD_OUT, TUNING = 7, 2, 3  # of crc32(doc_id): scored only; training, kept for the mixer
BATCH_WORDS = 20_000
SCORED_WORDS = 4_000
TEXT_WORDS = 1 << 20  # words whose heads are looked at together
PIECES = 512  # of the tables, summed apart
MICRO = 1e6  # scores of words travel as whole millionths
SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
          "bits_per_byte double")


def kind_of(words: list[bytes]) -> int:
    """Hash class of the most frequent word (of equal ones the first in byte order)."""
    if not words:
        return 0
    counts = Counter(words)
    most = max(counts.values())
    return zlib.crc32(min(w for w, n in counts.items() if n == most)) % KINDS


def word_blocks(docs: DataFrame) -> DataFrame:
    """Blocks whose keys are (kind, word), with training counts: of all folds, and of the tuning fold.

    A block's documents come with the numbers of their words in text order and the edges of its words.
    """
    def add(block: Ordered, batch: pa.RecordBatch) -> None:
        texts = utf8(batch.column(1))
        words = [x.lower().split() for x in texts]
        kinds = [kind_of(x) for x in words]
        ids = batch.column(0).to_pylist()
        fold = np.array([-1 if i is None else zlib.crc32(str(i).encode()) % FOLDS for i in ids])
        marks = [bytes([k]) for k in range(KINDS)]
        keys = [[m + w for w in x] + [m] for x, m in zip(words, (marks[k] for k in kinds))]
        size = np.fromiter((sum(map(len, x)) + len(x) + 1 for x in words), np.int64, len(words))
        block.add(keys, {"doc_id": np.array(ids, object), "fold": fold, "kind": np.array(kinds, np.uint8), "size": size}, sum(map(len, texts)))

    def close(block: Ordered) -> Closed:
        keys, facts = list(block.number), block.all_facts()
        weight, extra = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = 0
        for counts, numbers, _ in block.parts:
            fold = np.repeat(facts["fold"][at:at + len(counts)], counts)
            at += len(counts)
            weight += np.bincount(numbers[(fold >= 0) & (fold != HELD_OUT)], minlength=len(keys))
            extra += np.bincount(numbers[fold == TUNING], minlength=len(keys))
        counts, numbers = (np.concatenate([x[i] for x in block.parts]) for i in range(2))
        first, last = (x.astype(np.uint32) for x in edges(keys, 1))
        kinds = np.fromiter((k[0] for k in keys), np.int32, len(keys))
        return Closed([k[1:].decode() for k in keys], facts | {"counts": narrow(counts), "numbers": planes(numbers), "first": planes(first), "last": planes(last)}, kinds, weight, extra)

    return in_blocks(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), add, close, "words", numbers=Ordered)


def read_along(documents: dict) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some words of a block at a time, in text order: (documents, which of them each word is in, its number, first bytes, bytes before)."""
    ends, numbers = np.cumsum(documents["counts"].astype(np.int64)), whole_numbers(documents["numbers"])
    first, last = (whole_numbers(documents[x]).astype(np.uint64) for x in ("first", "last"))
    for at in range(0, len(numbers), TEXT_WORDS):
        back = max(0, at - 2)  # two words before tell the bytes before
        own = numbers[back:at + TEXT_WORDS]
        owner = np.searchsorted(ends, np.arange(back, back + len(own)), side="right")
        starts = np.append(True, owner[1:] != owner[:-1])
        before = before_words(last[own], starts)
        own, owner, before = own[at - back:], owner[at - back:], before[at - back:]
        which = slice(int(owner[0]), int(owner[-1]) + 1)
        yield which, owner - which.start, own, first[own], before


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several (keys, counts), with their sums."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, at, np.concatenate([n for _, n in parts]))
    return keys, counts


def counted_heads(documents: dict, wanted: Callable[[np.ndarray], np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each place the distinct keys of heads in documents whose fold is ``wanted``, and how often they come."""
    taken, none = wanted(documents["fold"]), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    found = [[none] for _ in range(HEAD)]
    for which, owner, _, first, before in read_along(documents):
        there = taken[which][owner]
        for parts, (keys, _, number) in zip(found, head_keys(documents["kind"][which][owner[there]], before[there], first[there])):
            parts.append((keys, np.bincount(number, minlength=len(keys))))
    return [summed(x) for x in found]


def documents_of(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("number") < 0).select("documents")


def vocabulary(blocks: DataFrame) -> DataFrame:
    """(key, kind, weight, extra, total, first): counts of each (kind, word), of the word in all kinds, and one mark per word."""
    rows = blocks.where(F.col("number") >= 0).select("key", "kind", "weight", "extra").repartition("key")
    counted = rows.groupBy("key", "kind").agg(F.sum("weight").alias("weight"), F.sum("extra").alias("extra"))
    by_word = Window.partitionBy("key")
    marked = counted.withColumn("total", F.sum("weight").over(by_word)).withColumn("first", F.row_number().over(by_word.orderBy("kind")) == 1)
    return written(marked, "vocabulary")


def word_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[bytes], np.ndarray, list[np.ndarray], pa.RecordBatch]]:
    """(words, kinds, further columns, rows) of (key, kind, ...) batches, ``size`` words at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            rest = [part.column(i).to_numpy(zero_copy_only=False) for i in range(2, part.num_columns)]
            yield utf8(part.column(0)), part.column(1).to_numpy(), rest, part


def tables(words: DataFrame, blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of all cells: from the training documents outside the tuning fold, and from all of them."""
    def pieces(own: Counts, tuning: bool) -> Iterator[pa.RecordBatch]:
        if not own.all.any():
            return
        for piece, part in enumerate(np.array_split(np.arange(CELLS), PIECES)):
            blob = pack([narrow(x[part[0]:part[-1] + 1]) for x in (own.ones, own.all)])
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([tuning]), pa.array([blob], pa.binary())], names=["piece", "tuning", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tuning = Counts(), False
        for keys, kinds, (n, fold), _ in word_batches(batches, BATCH_WORDS):
            own.add(keys, kinds, n, HEAD)
            tuning = bool(fold[0])
        yield from pieces(own, tuning)

    def add_heads(own: Counts, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        for place, (keys, n) in enumerate(found):
            for at in range(0, len(keys), BATCH_WORDS):
                own.add(*heads(keys[at:at + BATCH_WORDS], place), n[at:at + BATCH_WORDS])

    def count_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = Counts(), None
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                documents = unpack(blob)
                add_heads(own, counted_heads(documents, lambda x: (x >= 0) & (x != HELD_OUT) & (x != TUNING)))
                tuned = counted_heads(documents, lambda x: x == TUNING)
                held = [summed([x, y]) for x, y in zip(held, tuned)] if held else tuned
        yield from pieces(own, False)
        if held:
            own = Counts()
            add_heads(own, held)
            yield from pieces(own, True)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bool, list[np.ndarray]]] = {}
        for batch in batches:
            for piece, tuning, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = unpack(blob)
                sums = held.setdefault(piece, {t: [np.zeros(len(own[0]), np.int64) for _ in range(2)] for t in (False, True)})[tuning]
                for total, x in zip(sums, own):
                    total += x
        for piece, sums in held.items():
            blob = log_odds(*sums[False]).tobytes() + log_odds(*(a + b for a, b in zip(sums[False], sums[True]))).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([blob], pa.binary())], names=["piece", "counts"])

    schema = "piece int, tuning boolean, counts binary"
    learnt = words.where("weight > extra").select("key", "kind", F.col("weight") - F.col("extra"), F.lit(False))
    tuned = words.where("extra > 0").select("key", "kind", "extra", F.lit(True))
    counted = mapped(learnt, schema, count).unionByName(mapped(tuned, schema, count)).unionByName(mapped(documents_of(blocks), schema, count_heads))
    without, whole = np.zeros(CELLS, np.int8), np.zeros(CELLS, np.int8)
    parts = np.array_split(np.arange(CELLS), PIECES)
    for row in mapped(counted.repartition("piece"), "piece int, counts binary", add).collect():  # two bytes per cell
        both, part = np.frombuffer(row["counts"], np.int8), parts[row["piece"]]
        without[part], whole[part] = both[:len(part)], both[len(part):]
    return without, whole


def mixer(words: DataFrame, blocks: DataFrame) -> Mixer:
    """Tables from all training documents; weights learnt online on each task's part of the tuning fold against tables without it, and averaged."""
    table, whole = tables(words, blocks)
    shared = words.sparkSession.sparkContext.broadcast(table)  # CELLS bytes

    def learnt(parts: Iterator[tuple[list[bytes] | Heads, np.ndarray, np.ndarray]], first: int) -> Iterator[pa.RecordBatch]:
        own = Mixer.start(shared.value)
        ones, total = np.zeros(256 * BUCKETS), np.zeros(256 * BUCKETS)
        for units, kinds, n in parts:
            own.learn(units, kinds, n, first)
            a, b = own.outcomes(units, kinds, n, first)
            ones, total = ones + a, total + b
        for name, values in (("weights", (own.weights * own.mass[:, None]).ravel().astype(float)), ("mass", own.mass), ("ones", ones), ("all", total)):
            cells = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells)), pa.array(cells), pa.array(values[cells])], names=["name", "cell", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from learnt(((keys, kinds, extra) for keys, kinds, (extra,), _ in word_batches(batches, SCORED_WORDS)), HEAD)

    def learn_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[Heads, np.ndarray, np.ndarray]]:
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    for place, (keys, n) in enumerate(counted_heads(unpack(blob), lambda x: x == TUNING)):
                        mixed = np.argsort(keys * A, kind="stable")  # else they come sorted
                        for at in range(0, len(keys), SCORED_WORDS):
                            part = mixed[at:at + SCORED_WORDS]
                            yield *heads(keys[part], place), n[part]

        yield from learnt(parts(), 0)

    schema = "name string, cell long, value double"
    tuning = words.where("extra > 0").select("key", "kind", "extra").sortWithinPartitions(F.xxhash64("key", "kind"))
    found = mapped(tuning, schema, learn).unionByName(mapped(documents_of(blocks), schema, learn_heads)).groupBy("name", "cell").agg(F.sum("value").alias("value"))
    sums = {"weights": np.zeros(GATES * WIDTH), "mass": np.zeros(GATES), "ones": np.zeros(256 * BUCKETS), "all": np.zeros(256 * BUCKETS)}
    for row in found.collect():  # as many rows as weights and cells of the refining map
        sums[row["name"]][row["cell"]] = row["value"]
    known = sums["mass"] > 0
    model = Mixer.start(whole)
    model.weights[known] = sums["weights"].reshape(GATES, WIDTH)[known] / sums["mass"][known, None]
    model.refine(sums["ones"], sums["all"])
    return model


def word_scores(words: DataFrame, model: Mixer) -> DataFrame:
    """(key, kind, total, cost): minus log10 probability of what follows the head of each (kind, word), in millionths."""
    shared = words.sparkSession.sparkContext.broadcast((model.table, model.weights, model.refined))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Mixer(*shared.value)
        for keys, kinds, _, rows in word_batches(batches, SCORED_WORDS):
            cost = np.rint(-own.log10(keys, kinds, HEAD) * MICRO).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cost)], names=["key", "kind", "total", "cost"])

    return mapped(words.select("key", "kind", "total"), "key string, kind int, total long, cost long", score)


def head_scores(model: Mixer) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """log10 probabilities of the heads of words by (kind, bytes before, first bytes); distinct ones are scored once."""
    known = [(np.zeros(0, np.uint64), np.zeros(0)) for _ in range(HEAD)]  # keys in order, and their scores

    def scores(kinds: np.ndarray, before: np.ndarray, first: np.ndarray) -> np.ndarray:
        found = np.zeros(len(kinds))
        for place, (keys, there, number) in enumerate(head_keys(kinds, before, first)):
            new = np.setdiff1d(keys, known[place][0])
            parts = [model.log10(*heads(new[i:i + SCORED_WORDS], place)) for i in range(0, len(new), SCORED_WORDS)]
            have, own = (np.concatenate(x) for x in zip(known[place], (new, np.concatenate([np.zeros(0), *parts]))))
            order = np.argsort(have, kind="stable")
            known[place] = have[order], own[order]
            found[there] += known[place][1][np.searchsorted(known[place][0], keys)][number]
        return found

    return scores


def lm_scores(docs: DataFrame) -> DataFrame:
    """Per row: tokens, known tokens, plain score, the model's log10 probability of the text, and its bits per byte."""
    blocks = word_blocks(docs)
    words = vocabulary(blocks)
    tokens, distinct = words.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.count_if(F.col("first") & (F.col("total") > 0))).first()
    ends = {r["kind"]: r["weight"] for r in words.where("key = ''").select("kind", "weight").collect()}  # one row per kind
    of_kind = np.log10([(ends.get(k, 0) + 1) / (sum(ends.values()) + KINDS) for k in range(KINDS)])
    model = mixer(words, blocks)
    scores = word_scores(words, model)
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.weights, model.refined))
    rows = blocks.where(F.col("number") >= 0).select("block", "number", "key", "kind")
    values = rows.join(scores, ["key", "kind"]).select("block", "number", "total", "cost")
    floor = math.log10(tokens + distinct + 1)

    def finish(documents: dict, total: np.ndarray, cost: np.ndarray) -> pa.Table:
        n, heads_of = len(documents["counts"]), head_scores(Mixer(*shared.value))
        known, base, score = np.zeros(n), np.zeros(n), of_kind[documents["kind"]]
        plain, rest = np.log10(total + 1.0) - floor, cost / MICRO
        for which, owner, own, first, before in read_along(documents):
            head = heads_of(documents["kind"][which][owner], before, first)
            for sums, values in ((known, total[own] > 0), (base, plain[own]), (score, head - rest[own])):
                sums[which] += np.bincount(owner, values, which.stop - which.start)
        unknown = documents["fold"] < 0
        return pa.table({
            "doc_id": pa.array(documents["doc_id"], pa.int64()), "held_out": pa.array(documents["fold"] == HELD_OUT, mask=unknown),
            "n_tokens": pa.array(documents["counts"].astype(np.int64)), "n_known": pa.array(known.astype(np.int64)),
            "train_tokens": pa.array(np.full(n, tokens, np.int64)), "base_score": pa.array(base),
            "score": pa.array(score), "bits_per_byte": pa.array(-score / math.log10(2) / documents["size"]),
        })

    return back_to_blocks(blocks, values, SCHEMA, finish)
