"""Quality rules with suffix-array repetition.

Words are runs of ``[^\\x20\\x09-\\x0D]``.  A suffix array over the words of each document,
with its longest common prefixes, gives at every position the longest phrase from there that
occurs elsewhere in the document.  Those are the maximal repeated substrings of the
longest-common-prefix intervals; the union of their spans is the repeated part.

A document is rejected when it has fewer than ``min_words`` words, when more than half of its
words lie in repeated three-word windows, when repeats of ``phrase_words`` words or more cover
more than ``max_covered`` of it, or when one repeat is longer than ``max_repeat`` words.

Null and empty texts have no words and are rejected; repeated rows each get their own result;
an empty table gives an empty table; other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, mapped, numbering, utf8
from .suffix import longest_repeat

MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
PHRASE_WORDS = 8
MAX_COVERED = 0.4
MAX_REPEAT = 100

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, covered_fraction double, longest_repeat long, kept boolean")


def code_points(raw: bytes) -> int:
    """Characters of UTF-8 text: bytes that don't continue one."""
    return len(raw) - int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80))


def repeated_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def spans_union(reach: np.ndarray, least: int) -> np.ndarray:
    """Positions inside some span [i, i + reach[i]) with a reach of ``least`` or more."""
    at = np.flatnonzero(reach >= least)
    edge = np.zeros(len(reach) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + reach[at], -1)
    return np.cumsum(edge[:-1]) > 0


def window_words(reach: np.ndarray, size: int) -> np.ndarray:
    """Positions inside a window of ``size`` words that the document has twice or more."""
    return spans_union(np.where(reach >= size, size, 0), size)


def measures(texts: list[bytes], phrase_words: int) -> dict[str, np.ndarray]:
    words = [x.split() for x in texts]
    counts = np.array([len(x) for x in words], np.int64)
    ids = np.fromiter(map(numbering().__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
    owner = np.repeat(np.arange(len(texts)), counts)
    reach = longest_repeat(ids, owner)

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=values, minlength=len(texts)).astype(np.int64)

    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, owner, reach)
    return {
        "n_words": counts,
        "word_chars": np.array([code_points(x) - sum(map(x.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))) for x in texts], np.int64),
        "n_symbols": np.array([len(x) - len(x.translate(None, SYMBOLS)) for x in texts], np.int64),
        "n_dup_lines": np.array([repeated_lines(x) for x in texts], np.int64),
        "n_repeat_words": per_text(window_words(reach, 3)),
        "covered": per_text(spans_union(reach, phrase_words)),
        "longest_repeat": longest,
    }


def verdict(m: dict[str, np.ndarray], min_words: int, max_covered: float, max_repeat: int) -> dict[str, np.ndarray]:
    failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    fraction = m["covered"] / np.maximum(m["n_words"], 1)
    kept = ~failed & (fraction <= max_covered) & (m["longest_repeat"] <= max_repeat)
    return {"base_failed": failed, "covered_fraction": fraction, "kept": kept}


def quality_rules(
    docs: DataFrame, min_words: int = MIN_WORDS, phrase_words: int = PHRASE_WORDS,
    max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """One row per document with its measures and the verdict ``kept``."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            m = measures(utf8(batch.column(1)), phrase_words)
            m |= verdict(m, min_words, max_covered, max_repeat)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[x]) for x in names[1:])], names=names)

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), SCHEMA, work)


def accepted(
    docs: DataFrame, min_words: int = MIN_WORDS, phrase_words: int = PHRASE_WORDS,
    max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """The documents that the rules keep, with all their columns, in one pass over the texts."""
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, at):
            m = measures(utf8(batch.column(at)), phrase_words)
            yield batch.filter(pa.array(verdict(m, min_words, max_covered, max_repeat)["kept"]))

    return mapped(docs, docs.schema, work)
