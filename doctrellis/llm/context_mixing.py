"""Logistic context mixing over the bits of texts.

A text is its words, each followed by a space, and a newline; each byte is eight binary
decisions down a tree of 255 nodes.  For every decision each predictor looks up a cell of its
hashed table by its context (the last one to four bytes of the text, those of the words before
included, or all bytes of the word so far; with or without the kind of the document) and the
node, and gives the log odds of the counts there.

The last four bytes reach beyond a word's first byte from its first ``HEAD`` places alone.  So
the decisions of a word are told in two parts: those of its head, which hang on the bytes
before it, and those of its rest, which are the same wherever the word stands.

A mixer adds the predictions with weights from the set that a gate (bit depth and place in the
word) selects, learnt by online gradient steps; an adaptive map from (node, mixed prediction)
refines the result.  The sum of the decisions' log10 probabilities is that of the word.

Tables have fixed sizes, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

# (bytes of context, or None for the whole word so far; with the kind; bits of the table)
PREDICTORS = ((1, True, 16), (2, True, 18), (3, True, 19), (4, False, 20), (None, False, 21), (None, True, 21))
OFFSETS = np.cumsum([0] + [1 << b for _, _, b in PREDICTORS])
CELLS = int(OFFSETS[-1])
KINDS = 16
SCALE = 12.0  # log odds are kept as eight-bit numbers in steps of 1 / SCALE
PLACES = 4
GATES = 8 * PLACES
WIDTH = len(PREDICTORS) + 1  # predictions and a constant
BUCKETS = 33  # of the refining map, over mixed log odds from -8 to 8
START = 0.25
RATE, LEAST_RATE, SLOWING = 0.2, 0.05, 20  # of online steps: at first, at last, and after how many it has halved
STEP_WORDS = 256
HEAD = 3  # places of a word whose contexts reach into the words before it
CODE = 9  # bits of a byte plus one in the keys of heads, where zero is no byte
FIELD = (1 << CODE) - 1
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
NODE, SPREAD = np.uint32(0xD6E8FEB9), np.uint32(0x9E3779B1)


@dataclass
class Spelled:
    """Bytes of words one after the other; of those that are not ``told`` only the contexts are wanted."""

    raw: np.ndarray
    word: np.ndarray  # number of the word of each byte
    place: np.ndarray  # of each byte in its word
    told: np.ndarray
    before: np.ndarray | None = None  # per word the bytes before its space, nearest first, each plus one


@dataclass
class Heads:
    """Single places of word heads, with the bytes before the word."""

    before: np.ndarray  # n x HEAD: bytes plus one, nearest first; zero where the text begins
    bytes: np.ndarray  # n x HEAD: the word's bytes up to the place
    place: np.ndarray

    def __len__(self) -> int:
        return len(self.place)

    def __getitem__(self, part) -> Heads:
        return Heads(self.before[part], self.bytes[part], self.place[part])


def spelled(words: list[bytes] | Heads, first: int = 0) -> Spelled:
    """The bytes of words from place ``first`` on, or of heads; the empty word is the end of a text."""
    if isinstance(words, Heads):
        column = np.arange(HEAD)
        held = column <= words.place[:, None]
        word, place = np.nonzero(held)
        return Spelled(words.bytes[held], word, place, (column == words.place[:, None])[held], words.before)
    raw = np.frombuffer(b"".join([w + b" " if w else b"\n" for w in words]), np.uint8)
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    place = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return Spelled(raw, np.repeat(np.arange(len(words)), sizes), place, place >= first)


def edges(words: list[bytes], skipped: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of each word the first ``HEAD`` bytes (its end is one of them) and the last ones, nearest to the next word first, ``CODE`` bits a byte.

    ``skipped`` bytes at the start are not the word's.
    """
    raw = np.frombuffer(b"".join(words) + bytes(1), np.uint8).astype(np.uint64) + np.uint64(1)
    whole = np.fromiter(map(len, words), np.int64, len(words))
    ends, sizes = np.cumsum(whole), whole - skipped
    first, last = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    for k in range(HEAD):
        shift, there = np.uint64(CODE * k), sizes > k
        first |= np.where(there, raw[np.where(there, ends - sizes + k, 0)], np.uint64(0)) << shift
        last |= np.where(there, raw[np.where(there, ends - 1 - k, 0)], np.uint64(0)) << shift
        first |= np.where(sizes == k, np.uint64(ord(" " if k else "\n") + 1), np.uint64(0)) << shift
    return first, last


def before_words(last: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Keys of the ``HEAD`` bytes of the text before each word's space, from the words' own last bytes.

    ``starts`` marks the first words of texts.  After a word of one or two bytes come a space and
    the bytes of the word before it.
    """
    bits, space, field = np.uint64(CODE), np.uint64(ord(" ") + 1), np.uint64(FIELD)
    shifted = lambda x: np.where(starts, np.uint64(0), np.concatenate([np.zeros(1, np.uint64), x[:-1]])[:len(x)])
    near = shifted(last)  # the word before
    further = shifted(near)  # the one before that
    tail = np.where(further > 0, space | (further & field) << bits, np.uint64(0))
    single, double = near >> bits == 0, near >> np.uint64(2 * CODE) == 0
    return np.where(single, near | tail << bits, np.where(double, near | (tail & field) << np.uint64(2 * CODE), near))


def head_keys(kinds: np.ndarray, before: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each place of heads: distinct keys of (kind, bytes before, bytes up to the place), the words that have the place, and their keys' numbers."""
    found = []
    for place in range(HEAD):
        near = before & np.uint64((1 << CODE * (HEAD - place)) - 1)  # no context of the place reads further back
        own = first & np.uint64((1 << CODE * (place + 1)) - 1)
        there = np.flatnonzero(own >> np.uint64(CODE * place))
        key = (kinds[there].astype(np.uint64) << np.uint64(2 * CODE * HEAD)) | near[there] << np.uint64(CODE * HEAD) | own[there]
        encoded = pa.array(key).dictionary_encode()
        found.append((encoded.dictionary.to_numpy(), there, encoded.indices.to_numpy()))
    return found


def heads(keys: np.ndarray, place: int) -> tuple[Heads, np.ndarray]:
    """The heads that keys stand for, and their kinds."""
    columns = (keys[:, None] >> (np.uint64(CODE) * np.arange(2 * HEAD, dtype=np.uint64))) & np.uint64(FIELD)
    head = Heads(columns[:, HEAD:], (np.maximum(columns[:, :HEAD], 1) - 1).astype(np.uint8), np.full(len(keys), place))
    return head, (keys >> np.uint64(2 * CODE * HEAD)).astype(np.int64)


def decisions(units: Spelled, kinds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(cells of each predictor, node, bit) of the eight decisions of each byte that is told."""
    raw, place, told = units.raw, units.place, units.told
    wide = raw.astype(np.uint64) + np.uint64(1)
    depth = np.arange(8)
    own = raw[told].astype(np.int64)[:, None]
    node = (1 << depth) | (own >> (8 - depth))
    bit = (own >> (7 - depth)) & 1
    power = np.cumprod(np.full(int(place.max(initial=0)) + 1, A))
    sums = np.cumsum(wide * power[place])
    earlier = np.concatenate([np.zeros(1, np.uint64), sums[:-1]])[:len(raw)]
    start = np.maximum.accumulate(np.where(place == 0, np.arange(len(raw)), 0))
    prefix = earlier - earlier[start]
    recent, contexts = np.zeros(len(raw), np.uint64), {None: prefix[told]}
    for k in range(1, 5):
        back = np.concatenate([np.zeros(k, np.uint64), wide[:-k]])[:len(raw)]
        if units.before is not None and k > 1:  # beyond the space before the word
            beyond = units.before[units.word, np.clip(k - 2 - place, 0, HEAD - 1)].astype(np.uint64)
            back = np.where(place >= k, back, np.where(place <= k - 2, beyond, np.uint64(0)))
        else:
            back = np.where(place >= k, back, np.uint64(0))
        recent = recent * np.uint64(257) + back
        contexts[k] = recent[told]
    kind = kinds[units.word[told]].astype(np.uint64) + np.uint64(1)
    nodes = node.astype(np.uint32) * NODE
    cells = []
    for o, (length, with_kind, bits) in enumerate(PREDICTORS):
        h = (contexts[length] + np.uint64(o + 1)) * A
        if with_kind:
            h = h + kind * B
        h ^= h >> np.uint64(29)
        spread = ((h * B) >> np.uint64(32)).astype(np.uint32)
        cells.append((((spread[:, None] + nodes) * SPREAD) >> np.uint32(32 - bits)).astype(np.intp))
    return cells, node, bit


class Counts:
    """How often each cell met a zero and a one."""

    def __init__(self):
        self.ones, self.all = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)

    def add(self, words: list[bytes] | Heads, kinds: np.ndarray, weights: np.ndarray, first: int = 0) -> None:
        units = spelled(words, first)
        cells, _, bit = decisions(units, kinds)
        weight = np.repeat(weights[units.word[units.told]].astype(np.int64), 8)
        one = np.flatnonzero(bit.ravel())
        of_ones = weight[one]
        for o, own in enumerate(cells):
            part, at = slice(OFFSETS[o], OFFSETS[o + 1]), own.ravel()
            np.add.at(self.all[part], at, weight)
            np.add.at(self.ones[part], at[one], of_ones)


def log_odds(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    ones, zeros = ones.astype(np.float32), (total - ones).astype(np.float32)
    return np.clip(np.rint(np.log((ones + 0.4) / (zeros + 0.4)) * SCALE), -127, 127).astype(np.int8)


@dataclass
class Mixer:
    table: np.ndarray  # log odds of all predictors' cells
    weights: np.ndarray  # gate x predictor
    refined: np.ndarray  # node x bucket: probability of a one
    steps: int = 0
    mass: np.ndarray = field(default_factory=lambda: np.zeros(GATES))  # what each gate has learnt from

    @staticmethod
    def start(table: np.ndarray) -> Mixer:
        weights = np.full((GATES, WIDTH), START, np.float32)
        weights[:, -1] = 0
        centres = 1 / (1 + np.exp(-(np.arange(BUCKETS) - BUCKETS // 2) / 2))
        return Mixer(table, weights, np.tile(centres, (256, 1)))

    def inputs(self, words: list[bytes] | Heads, kinds: np.ndarray, first: int = 0) -> tuple[np.ndarray, ...]:
        units = spelled(words, first)
        cells, node, bit = decisions(units, kinds)
        x = np.ones((WIDTH, len(node), 8), np.float32)
        for o, own in enumerate(cells):
            np.multiply(self.table[OFFSETS[o]:OFFSETS[o + 1]][own], np.float32(1 / SCALE), out=x[o])
        return x, np.minimum(units.place[units.told], PLACES - 1), node, bit, units.word[units.told]

    def mixed(self, x: np.ndarray, place: np.ndarray) -> np.ndarray:
        mixed = np.empty(x.shape[1:], np.float32)
        for at, own in enumerate(self.weights.reshape(PLACES, 8, WIDTH)):
            rows = np.flatnonzero(place == at)
            part = slice(None) if len(rows) == len(place) else rows
            if len(rows):
                mixed[part] = np.einsum("knb,bk->nb", x[:, part], own)
        return np.clip(mixed, -15, 15)

    def learn(self, words: list[bytes] | Heads, kinds: np.ndarray, counts: np.ndarray, first: int = 0) -> None:
        """One online step for each ``STEP_WORDS`` words; the step of a gate is over its decisions in them."""
        inputs, gates, _, bits, numbers = self.inputs(words, kinds, first)
        steps = np.searchsorted(numbers, np.arange(0, len(words) + STEP_WORDS, STEP_WORDS))
        for part in (slice(a, b) for a, b in zip(steps, steps[1:]) if a < b):
            x, place = inputs[:, part], gates[part]
            error = bits[part] - 1 / (1 + np.exp(-self.mixed(x, place)))
            weight = counts[numbers[part]].astype(np.float32)[:, None]
            pull = error * weight
            gate = (place[:, None] * 8 + np.arange(8)).ravel()
            rate = max(LEAST_RATE, RATE / (1 + self.steps / SLOWING))
            self.steps += 1
            mass = np.bincount(gate, np.broadcast_to(weight, pull.shape).ravel(), GATES)
            self.mass += mass
            for k in range(WIDTH):
                total = np.bincount(gate, (pull * x[k]).ravel(), GATES)
                self.weights[:, k] += (rate * total / np.maximum(mass, 1)).astype(np.float32)

    def bucket(self, s: np.ndarray) -> np.ndarray:
        return np.rint(np.clip(s, -8, 8) * 2).astype(np.int64) + BUCKETS // 2

    def outcomes(self, words: list[bytes] | Heads, kinds: np.ndarray, counts: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ones, all) of each node and bucket, for the refining map."""
        x, place, node, bit, word = self.inputs(words, kinds, first)
        at = (node * BUCKETS + self.bucket(self.mixed(x, place))).ravel()
        weight = np.repeat(counts[word].astype(float), 8)
        return np.bincount(at, weight * bit.ravel(), 256 * BUCKETS), np.bincount(at, weight, 256 * BUCKETS)

    def refine(self, ones: np.ndarray, total: np.ndarray, prior: float = 20.0) -> None:
        self.refined = (ones.reshape(256, BUCKETS) + prior * self.refined) / (total.reshape(256, BUCKETS) + prior)

    def log10(self, words: list[bytes] | Heads, kinds: np.ndarray, first: int = 0) -> np.ndarray:
        """log10 probability of each word from place ``first`` on, or of each place of a head."""
        x, place, node, bit, word = self.inputs(words, kinds, first)
        s = self.mixed(x, place)
        p = 0.5 / (1 + np.exp(-s)) + 0.5 * self.refined[node, self.bucket(s)]
        p = np.clip(np.where(bit == 1, p, 1 - p), 1e-6, 1)
        return np.bincount(word, np.log10(p).sum(axis=1), len(words))
