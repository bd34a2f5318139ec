"""Texts as chunks that are tokenised once each.

The byte-level pattern starts a match at every space before a visible character, whatever
stands around it, so a text may be cut there.  A block of texts has far fewer distinct chunks
than chunks, and those have fewer distinct pre-tokens still: only these are tokenised.
"""

from __future__ import annotations

import gc
import re
from itertools import chain, islice

import numpy as np

from .common import numbering

def ragged(flat: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists number ``numbers`` of (flat, lengths), end to end, and their lengths."""
    each = lengths[numbers]
    ends = np.cumsum(each)
    starts = np.cumsum(lengths) - lengths
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[numbers] - (ends - each), each)], each


class ChunkEncoder:
    """Subclasses give ``tokenise``: the ids of pre-tokens, end to end, and how many each has."""

    dtype = np.uint16
    most = 700_000  # chunks remembered before starting anew; bounds memory, not results

    def __init__(self):
        import regex
        from public_tokenizers import PATTERN

        self.pattern = regex.compile(PATTERN)
        self.odd = re.compile(r" (?!\S)")
        self.cut = re.compile(r" (?=\S)")
        self.forget()

    def tokenise(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def forget(self) -> None:
        self.number, self.pretoken = numbering(), numbering()
        self.flat, self.lengths = np.zeros(0, self.dtype), np.zeros(0, np.int64)  # of chunks
        self.piece_flat, self.piece_lengths = np.zeros(0, self.dtype), np.zeros(0, np.int64)  # of pre-tokens

    def chunks(self, text: str) -> list[str]:
        parts = self.cut.split(text) if self.odd.search(text) else text.split(" ")
        parts[0] = " " + parts[0]  # only a first chunk starts so: it has no space of its own
        return parts

    def parts(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pre-tokens of chunks, end to end, and how many each chunk has."""
        get, found, sizes = self.pretoken.__getitem__, [], []
        add, size = found.append, sizes.append
        for chunk in fresh:
            if chunk.isalpha():
                add(get(" " + chunk))
                size(1)
            elif chunk[:-1].isalpha() and chunk[-1] in ".,":
                add(get(" " + chunk[:-1]))
                add(get(chunk[-1]))
                size(2)
            else:
                parts = self.pattern.findall(chunk[1:] if chunk[0] == " " else " " + chunk)
                found += map(get, parts)
                size(len(parts))
        return np.array(found, np.int64), np.array(sizes, np.int64)

    def learn(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known = len(self.pretoken)
        numbers, sizes = self.parts(fresh)
        if len(self.pretoken) > known:
            flat, lengths = self.tokenise(list(islice(self.pretoken, known, None)))
            self.piece_flat, self.piece_lengths = np.concatenate([self.piece_flat, flat]), np.concatenate([self.piece_lengths, lengths])
        ids, each = ragged(self.piece_flat, self.piece_lengths, numbers)
        owner = np.repeat(np.arange(len(fresh)), sizes)
        self.flat = np.concatenate([self.flat, ids])
        self.lengths = np.concatenate([self.lengths, np.bincount(owner, weights=each, minlength=len(fresh)).astype(np.int64)])
        return numbers, sizes

    def numbers(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(chunk numbers end to end, chunks per text); new chunks are learnt."""
        if len(self.number) > self.most:
            self.forget()
        known = len(self.number)
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        if len(self.number) > known:
            gc.disable()  # nothing here is cyclic, and scans of so many small objects are dear
            self.learn(list(islice(self.number, known, None)))
            gc.enable()
        return numbers, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids per text)."""
        numbers, counts = self.numbers([self.chunks(t) for t in texts])
        ids, each = ragged(self.flat, self.lengths, numbers)
        return ids, np.bincount(np.repeat(np.arange(len(texts)), counts), weights=each, minlength=len(texts)).astype(np.int64)
