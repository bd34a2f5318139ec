"""Benchmark passages in documents, by CGK embedding and bit sampling.

Texts are lower-cased and every run of ASCII other than letters and digits is one space.
Items are grouped by length, and the windows of a group are sized after its items.  An item has
a window at each of its bytes, a document one at every few bytes, whatever the text there is, so
some windows of a document that holds the item begin where one of the item does.

The CGK walk embeds a window: step j reads the current byte and moves on if a random function
of j says so for that byte, so strings of small edit distance become strings of small Hamming
distance.  Tables sample ``SAMPLES`` positions of one of ``WALKS`` walks.  How many there are is
calibrated: items (``CALIBRATION`` of a group at most) are damaged at the limit of ``EDITS``
inside other text, and tables are added until ``RECALL`` of them are met.  Windows that agree in
a table and have a small Hamming distance are candidates; the item is then compared with the
text around by exact edit distance (bit-parallel, free ends in the text).  A match has an edit
distance of at most ``EDITS`` of the item's length.

Items under ``SHORTEST`` bytes are searched exactly, as they are, with an automaton; they match
where they don't cut an ASCII word.

Items are taken in blocks of ``ITEMS`` (a stated query set); every block meets all documents
and whole texts, and tasks make its tables from the texts of the items.  Null and empty items
match nothing; null and empty texts hold nothing; repeated rows are searched each; empty tables
give empty results; columns beyond the named ones are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, mapped

SHORTEST = 24
#: Least item length of a group, its window, bytes between windows of a document, sampled positions.
GROUPS = [(48, 32, 8, 12), (SHORTEST, 16, 3, 9)]
WALKS, TABLES, SEED = 2, 12, 11  # tables of each walk, at most
RECALL, CALIBRATION = 0.99, 300
UNLIKE = 0.25  # of positions that differ, at most
EDITS = 0.15
ITEMS = 4000
PART = 40_000  # windows embedded together

MATCHES = "doc_id long, item_id long, start int, end int, distance int"

PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)
)


def plain(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(PLAIN).split())


def plain_with_places(text: str) -> tuple[bytes, list[int]]:
    """As ``plain``, and for each byte the character of ``text`` it comes from."""
    out, places, gap = bytearray(), [], False
    for i, c in enumerate(text):
        for b in c.lower().encode():
            b = PLAIN[b]
            if b == 32:
                gap = bool(out)
                continue
            if gap:
                out.append(32)
                places.append(i)
                gap = False
            out.append(b)
            places.append(i)
    return bytes(out), places


@dataclass
class Embedding:
    steps: int
    moves: np.ndarray  # walk x step x byte
    sampled: np.ndarray  # table x sample; tables of walks take turns
    weights: np.ndarray  # samples of a table into one key

    @staticmethod
    def make(window: int, samples: int) -> Embedding:
        rng = np.random.default_rng(SEED)
        steps = window * 3 // 2
        return Embedding(
            steps, rng.integers(0, 2, (WALKS, steps, 256)).astype(np.int64),
            np.stack([np.sort(rng.choice(steps, samples, replace=False)) for _ in range(WALKS * TABLES)]),
            rng.integers(1, 1 << 62, (WALKS * TABLES, samples)).astype(np.uint64) | np.uint64(1),
        )

    def keys(self, buffer: np.ndarray, starts: np.ndarray, tables: int) -> tuple[np.ndarray, np.ndarray]:
        """(walk, step, window) embedded bytes and (table, window) keys of the windows at ``starts``.

        The buffer goes on for ``steps`` bytes beyond the last start.
        """
        embedded = np.empty((min(WALKS, tables), self.steps, len(starts)), np.uint8)
        out = np.zeros((tables, len(starts)), np.uint64)
        for w in range(len(embedded)):
            uses = defaultdict(list)
            for t in range(w, tables, WALKS):
                for s, j in enumerate(self.sampled[t].tolist()):
                    uses[j].append((t, self.weights[t, s]))
            at = starts.copy()
            for j in range(self.steps):
                byte = np.take(buffer, at, out=embedded[w, j])
                if j in uses:
                    wide = byte.astype(np.uint64)
                    for table, weight in uses[j]:
                        out[table] += wide * weight
                if j + 1 < self.steps:
                    at += self.moves[w, j][byte]
        return embedded, out ^ (out >> np.uint64(31))


def edit_match(item: bytes, text: bytes, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the part of ``text`` closest to ``item``, or None beyond ``most``."""
    def best_end(pattern: bytes, over: bytes, anchored: bool) -> tuple[int, int]:
        n = len(pattern)
        full, high = (1 << n) - 1, 1 << (n - 1)
        peq = defaultdict(int)
        for i, b in enumerate(pattern):
            peq[b] |= 1 << i
        up, down, score = full, 0, n
        best, end = n, 0
        for j, b in enumerate(over):
            eq = peq.get(b, 0)
            x = (((eq & up) + up) ^ up) | eq | down
            ph, mh = down | ~(x | up) & full, up & x
            score += bool(ph & high) - bool(mh & high)
            ph = ph << 1 | (1 if anchored else 0)
            up = (mh << 1 | ~(eq | down | ph)) & full
            # vertical state of the bit-parallel recurrence
            down = ph & (eq | down) & full
            if score < best:
                best, end = score, j + 1
        return best, end

    distance, end = best_end(item, text, False)
    if distance > most:
        return None
    back, length = best_end(item[::-1], text[:end][::-1], True)
    return distance, end - length, end


def may_match(item: bytes, text: bytes, most: int) -> bool:
    """Whether enough runs of four bytes are shared: an edit takes four of them away at most."""
    there = {text[i:i + 4] for i in range(len(text) - 3)}
    return sum(item[i:i + 4] in there for i in range(len(item) - 3)) >= len(item) - 3 - 4 * most


def runs(numbers: list[int]) -> Iterator[tuple[int, int]]:
    """First and last of each run of numbers that follow each other."""
    first = last = numbers[0]
    for n in numbers[1:]:
        if n > last + 1:
            yield first, last
            first = n
        last = n
    yield first, last


@dataclass
class Group:
    """Windows of items of similar length, by table."""

    window: int
    stride: int
    embedding: Embedding
    item: np.ndarray  # of each window
    offset: np.ndarray  # in the item
    embedded: np.ndarray  # walk x window x step
    keys: np.ndarray  # table x window, sorted
    order: np.ndarray  # windows in that order
    seen: np.ndarray  # table x low bits: whether some window has such a key

    @staticmethod
    def make(numbers: list[int], passages: list[bytes], window: int, stride: int, samples: int, tables: int = WALKS * TABLES) -> Group:
        embedding = Embedding.make(window, samples)
        sizes = np.array([len(p) for p in passages])
        many = sizes - window + 1
        offset = np.concatenate([np.arange(n) for n in many])
        begin = np.cumsum(sizes + 1) - sizes - 1
        buffer = np.frombuffer(b" ".join(passages) + b" " + bytes(embedding.steps), np.uint8)
        embedded, keys = embedding.keys(buffer, np.repeat(begin, many) + offset, tables)
        order = np.argsort(keys, axis=1, kind="stable")
        bits = max(16, int(len(offset)).bit_length() + 4)
        seen = np.zeros((tables, 1 << bits), bool)
        for table in range(tables):
            seen[table, keys[table] & np.uint64((1 << bits) - 1)] = True
        return Group(window, stride, embedding, np.repeat(numbers, many), offset, np.ascontiguousarray(embedded.transpose(0, 2, 1)), np.take_along_axis(keys, order, axis=1), order, seen)

    def agreeing(self, buffer: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(table, number of a start, window of an item) of windows that agree in a table and are alike."""
        embedded, keys = self.embedding.keys(buffer, starts, len(self.keys))
        low = np.uint64(self.seen.shape[1] - 1)
        for table, own in enumerate(keys):
            at = np.flatnonzero(self.seen[table][own & low])
            first, last = (np.searchsorted(self.keys[table], own[at], side=s) for s in ("left", "right"))
            many = last - first
            at = np.repeat(at, many)
            if len(at):
                other = self.order[table][np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(at))]
                walk = table % WALKS
                apart = np.concatenate([
                    (embedded[walk][:, at[a:a + PART]].T != self.embedded[walk][other[a:a + PART]]).sum(axis=1) for a in range(0, len(at), PART)])
                near = apart <= UNLIKE * self.embedding.steps
                yield table, at[near], other[near]


def damaged(item: bytes, edits: int, rng: np.random.Generator) -> bytes:
    """The item after that many edits at random places."""
    out = bytearray(item)
    for kind in rng.integers(0, 3, edits).tolist():
        at, byte = int(rng.integers(0, len(out))), int(rng.integers(97, 123))
        out[at:at + (kind < 2)] = b"" if kind == 0 else bytes([byte])
    return bytes(out)


def tables_for(passages: list[bytes], window: int, stride: int, samples: int) -> int:
    """Tables with which ``RECALL`` of items that are damaged at the limit agree in a window where they should."""
    rng = np.random.default_rng(SEED)
    chosen = [passages[i] for i in sorted(rng.choice(len(passages), min(CALIBRATION, len(passages)), replace=False).tolist())]
    group = Group.make(list(range(len(chosen))), chosen, window, stride, samples)
    first = []
    for i, p in enumerate(chosen):
        before = chosen[int(rng.integers(0, len(chosen)))][:int(rng.integers(window, 2 * window))]
        text = before + b" " + damaged(p, int(EDITS * len(p)), rng) + b" " + before[::-1]
        buffer = np.frombuffer(text + bytes(group.embedding.steps + 1), np.uint8)
        starts = np.arange(int(rng.integers(0, stride)), len(text), stride)
        met = WALKS * TABLES
        for table, at, other in group.agreeing(buffer, starts):
            own = group.item[other] == i
            if (own & (np.abs(starts[at] - len(before) - 1 - group.offset[other]) <= window)).any():
                met = table
                break
        first.append(met)
    met = np.sort(first)
    enough = int(met[int(np.ceil(RECALL * len(met))) - 1]) + 1
    return min(enough, WALKS * TABLES)


@dataclass
class Searcher:
    items: list[tuple[int, bytes]]
    groups: list[Group]
    short: object  # automaton of short items, if there are any

    @staticmethod
    def make(items: list[tuple[int, bytes]]) -> Searcher | None:
        if not items:
            return None
        groups, longest = [], 1 << 60
        for least, window, stride, samples in GROUPS:
            own = [n for n, (_, p) in enumerate(items) if least <= len(p) < longest]
            if own:
                passages = [items[n][1] for n in own]
                groups.append(Group.make(own, passages, window, stride, samples, tables_for(passages, window, stride, samples)))
            longest = least
        short = None
        for n, (_, p) in enumerate(items):
            if len(p) < SHORTEST:
                import ahocorasick

                short = ahocorasick.Automaton() if short is None else short
                word = p.decode("latin-1")
                short.add_word(word, [*short.get(word, []), n])
        if short is not None:
            short.make_automaton()
        return Searcher(items, groups, short)

    def candidates(self, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(text, item, where the item would start) of windows that agree in some table."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        begins = np.cumsum(sizes) - sizes
        for group in self.groups:
            buffer = np.frombuffer(b" ".join(texts) + b" " + bytes(group.embedding.steps), np.uint8)
            starts, found = np.arange(0, int(sizes.sum()), group.stride), []
            for at in range(0, len(starts), PART):
                part = starts[at:at + PART]
                found += [np.stack([part[w], group.item[o], group.offset[o]]) for _, w, o in group.agreeing(buffer, part)]
            if found:
                for place, item, offset in np.unique(np.concatenate(found, axis=1), axis=1).T.tolist():
                    text = int(np.searchsorted(begins, place, side="right")) - 1
                    yield text, item, place - int(begins[text]) - offset

    def short_matches(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(item, start): the first place of each short item that cuts no ASCII word."""
        word = lambda i: 0 <= i < len(text) and text[i] < 128 and text[i] != 32
        done = set()
        for last, numbers in self.short.iter(text.decode("latin-1")):
            size = len(self.items[numbers[0]][1])
            start = last + 1 - size
            if not (word(start) and word(start - 1) or word(last) and word(last + 1)):
                for n in numbers:
                    if n not in done:
                        done.add(n)
                        yield n, start

    def matches(self, texts: list[str | None], share: float) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item id, start, end, distance): the closest place of each item that a text holds."""
        normal = [plain(x) if x else b"" for x in texts]
        near = defaultdict(set)
        for text, item, start in self.candidates(normal):
            near[text, item].add(start // 16)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for (text, item), starts in near.items():
            passage = self.items[item][1]
            most = int(share * len(passage))
            for first, last in runs(sorted(starts)):
                low = max(0, first * 16 - most)
                around = normal[text][low:max(0, last * 16 + 16 + len(passage) + most)]
                found = edit_match(passage, around, most) if may_match(passage, around, most) else None
                if found and ((text, item) not in best or found[0] < best[text, item][0]):
                    best[text, item] = found[0], low + found[1], low + found[2]
                    if not found[0]:
                        break
        if self.short is not None:
            for text, own in enumerate(normal):
                for item, start in self.short_matches(own):
                    best[text, item] = 0, start, start + len(self.items[item][1])
        places: tuple[int, list[int]] = (-1, [])
        for (text, item), (distance, start, end) in sorted(best.items()):
            if places[0] != text:
                places = text, plain_with_places(texts[text])[1]
            yield text, self.items[item][0], places[1][start], places[1][end - 1] + 1, distance


class LazySearcher:
    """Texts of items; their tables are made where they are used, once a task."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = items

    def __call__(self) -> Searcher:
        return Searcher.make(self.items)


def item_blocks(benchmark: DataFrame, size: int) -> Iterator[LazySearcher]:
    """Blocks of about ``size`` items each."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = -(-items.count() // size)
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        usable = [(i, p) for i, p in ((r["item_id"], plain(r["text"])) for r in own.orderBy("item_id", "text").collect() if r["text"]) if p]  # a block
        if usable:
            yield LazySearcher(usable)


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = EDITS, size: int = ITEMS) -> DataFrame:
    """One row for each document and item it holds: closest place in characters, and its edit distance."""
    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def search(block: LazySearcher) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = block()
            for batch in bounded(batches):
                rows = list(searcher.matches(batch.column(1).to_pylist(), share))
                columns = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64())]
                columns += [pa.array([r[k] for r in rows], pa.int32()) for k in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "start", "end", "distance"])

        return mapped(picked, MATCHES, work)

    found = None
    for block in item_blocks(benchmark, size):
        found = search(block) if found is None else found.unionByName(search(block))
    return docs.sparkSession.createDataFrame([], MATCHES) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, share: float = EDITS, size: int = ITEMS) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    at = docs.columns.index("text")
    for block in item_blocks(benchmark, size):
        def work(batches: Iterator[pa.RecordBatch], block: LazySearcher = block) -> Iterator[pa.RecordBatch]:
            searcher = block()
            for batch in bounded(batches, at):
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in searcher.matches(batch.column(at).to_pylist(), share)]] = False
                yield batch.filter(pa.array(keep))

        docs = mapped(docs, docs.schema, work)
    return docs
