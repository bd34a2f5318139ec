"""Secrets by patterns and by character Markov models.

Patterns find assignments, access keys and long hexadecimal runs.  The models add what has no
such form: first-order Markov models of random strings (one per alphabet, trained from seeded
samples of that label) against one of ordinary text (trained from the character pairs of all
documents).  A candidate is what the patterns' spans leave of a run of key characters; it is a
secret if the log-likelihood ratio of the best random model against ordinary text reaches
``TOTAL`` in all and ``PER_CHAR`` per character.

Positions are code points, ends exclusive.  Null and empty texts have no spans; repeated rows
and null ids are scanned row by row; an empty table gives an empty table (and ordinary text is
then uniform).  Redaction keeps every row and column.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded, mapped, utf8

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE_LENGTH = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{CANDIDATE_LENGTH},}}"

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
OUTSIDE = len(SYMBOLS)  # any other character
STATES = OUTSIDE + 1
ALPHABETS = (
    "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "abcdefghijklmnopqrstuvwxyz0123456789", SYMBOLS[:62], SYMBOLS[:64], SYMBOLS[:62] + "_-",
)
SAMPLES, SAMPLE_LENGTH, SEED = 400, 40, 7  # labelled random strings per alphabet
TOTAL, PER_CHAR = 15.0, 0.6
IDENTIFIERS = 0.1  # weight of words as they stand in identifiers, against words in text

CODES = np.full(256, OUTSIDE, np.int64)
CODES[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(OUTSIDE)

SPANS = "array<struct<kind:string,start:int,end:int>>"
MARK = "[SECRET]"


def log_transitions(pairs: np.ndarray) -> np.ndarray:
    """log P(next | this) with half a count added to each pair."""
    smooth = pairs.astype(float) + 0.5
    return np.log(smooth / smooth.sum(axis=1, keepdims=True))


def as_identifiers(pairs: np.ndarray) -> np.ndarray:
    """Pairs of ordinary text with those of identifiers made of its words.

    Words are also joined by each of ``+/_=-`` and in camel case, and spelt in capitals; any
    character may repeat, and numbers follow words and separators.
    """
    out = pairs.astype(float)
    upper, lower, digits, joints = (np.array([SYMBOLS.index(c) for c in x]) for x in (SYMBOLS[:26], SYMBOLS[26:52], SYMBOLS[52:62], SYMBOLS[62:]))
    letters, share = np.concatenate([upper, lower]), IDENTIFIERS
    ends, starts = pairs[letters, OUTSIDE], pairs[OUTSIDE, letters]
    for joint in joints:
        out[letters, joint] += share * ends
        out[joint, letters] += share * starts
        out[joint, joint] += share * ends.sum()
        out[joint, digits] += share * ends.sum() / 100
    out[np.ix_(upper, upper)] += share * pairs[np.ix_(lower, lower)]
    for joint in joints:
        out[upper, joint] += share * pairs[lower, OUTSIDE]
        out[joint, upper] += share * pairs[OUTSIDE, lower]
    out[letters, letters] += share * ends.sum() / 10
    out[np.ix_(digits, digits)] += share * ends.sum() / 10
    out[np.ix_(digits, joints)] += share * ends.sum() / 100
    starts_as_capital = pairs[OUTSIDE, lower] + pairs[OUTSIDE, upper]
    out[np.ix_(lower, upper)] += share * np.outer(pairs[lower, OUTSIDE], starts_as_capital) / max(starts_as_capital.sum(), 1)
    out[np.ix_(letters, digits)] += share * ends[:, None] / 100
    return out


def random_models() -> np.ndarray:
    """Transitions of each alphabet, trained from its sample of random strings."""
    rng = np.random.default_rng(SEED)
    models = []
    for alphabet in ALPHABETS:
        codes = CODES[np.frombuffer(alphabet.encode(), np.uint8)]
        sample = codes[rng.integers(0, len(codes), (SAMPLES, SAMPLE_LENGTH))]
        pairs = np.zeros((STATES, STATES))
        np.add.at(pairs, (sample[:, :-1].ravel(), sample[:, 1:].ravel()), 1)
        np.add.at(pairs, (np.full(SAMPLES, OUTSIDE), sample[:, 0]), 1)
        pairs[np.ix_(codes, codes)] = pairs[np.ix_(codes, codes)].mean()  # random strings have no favourite pairs
        models.append(log_transitions(pairs * 100))
    return np.stack(models)


def ordinary_model(docs: DataFrame) -> np.ndarray:
    """Transitions over the texts of all documents."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STATES * STATES, np.int64)
        for batch in bounded(batches, 0):
            codes = CODES[np.frombuffer(b"\n".join([b"", *utf8(batch.column(0)), b""]), np.uint8)]
            total += np.bincount(codes[:-1] * STATES + codes[1:], minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    counted = mapped(docs.select(F.col("text").cast("string")), "cell long, n long", work)
    pairs = np.zeros(STATES * STATES)
    for row in counted.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most STATES squared rows
        pairs[row["cell"]] = row["n"]
    return log_transitions(as_identifiers(pairs.reshape(STATES, STATES)))


def ratio(candidate: str, random: np.ndarray, ordinary: np.ndarray) -> float:
    """Log-likelihood ratio of the best random model against ordinary text."""
    codes = np.concatenate([[OUTSIDE], CODES[np.frombuffer(candidate.encode(), np.uint8)]])
    return float((random[:, codes[:-1], codes[1:]].sum(axis=1)).max() - ordinary[codes[:-1], codes[1:]].sum())


def merged(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Ranges that spans cover, apart and in order."""
    out: list[tuple[int, int]] = []
    for _, a, b in sorted(spans, key=lambda x: x[1]):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def uncovered(start: int, end: int, covered: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What ``covered`` ranges leave of a range."""
    for k in range(max(0, bisect_left(covered, (start,)) - 1), len(covered)):
        a, b = covered[k]
        if a >= end:
            break
        if a > start:
            yield start, a
        start = max(start, b)
    if start < end:
        yield start, end


class Scanner:
    def __init__(self, ordinary: np.ndarray, total: float, per_char: float):
        self.random, self.ordinary, self.total, self.per_char = random_models(), ordinary, total, per_char
        self.assign = re.compile(ASSIGN, re.A | re.I)
        self.others = [("access", re.compile(ACCESS)), ("hex", re.compile(HEX))]
        self.candidate = re.compile(CANDIDATE)

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        found = [("assign", *m.span()) for m in self.assign.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
        found += [(kind, *m.span()) for kind, pattern in self.others for m in pattern.finditer(text)]
        base = merged(found)
        for m in self.candidate.finditer(text):
            for a, b in uncovered(*m.span(), base):
                if b - a < CANDIDATE_LENGTH:
                    continue
                score = ratio(text[a:b], self.random, self.ordinary)
                if score >= self.total and score >= self.per_char * (b - a):
                    found.append(("random", a, b))
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    parts, at = [], 0
    for _, a, b in spans:
        if a >= at:
            parts += [text[at:a], MARK]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def secret_spans(docs: DataFrame, ordinary: np.ndarray | None = None, total: float = TOTAL, per_char: float = PER_CHAR) -> DataFrame:
    """doc_id and the spans of every row, by start and kind."""
    ordinary = ordinary_model(docs) if ordinary is None else ordinary

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ordinary, total, per_char)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in bounded(batches):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scanner.spans(x or "")] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), f"doc_id long, spans {SPANS}", work)


def redact(docs: DataFrame, ordinary: np.ndarray | None = None, total: float = TOTAL, per_char: float = PER_CHAR) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mark and ``n_chars``, if there, brought into line."""
    ordinary = ordinary_model(docs) if ordinary is None else ordinary
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ordinary, total, per_char)
        for batch in bounded(batches, at):
            texts = [x and redacted(x, scanner.spans(x)) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    cleaned = mapped(docs, docs.schema, work)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts per pattern, a digest of the pattern spans, and all spans as text."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
