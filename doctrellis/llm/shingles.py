"""Word shingles as 64-bit hashes, in numpy."""

from __future__ import annotations

from itertools import chain

import numpy as np

from .common import numbering

SIZE = 5
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every 5-word shingle, repeats included; A-Z lower-cased.

    A text of fewer words is one shingle, a text without words has none.
    """
    import xxhash

    words = [x.lower().split() for x in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    number = numbering()
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    of_word = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
    h = np.concatenate([of_word[ids], np.zeros(SIZE, np.uint64)])
    n = len(ids)
    owner = np.repeat(np.arange(len(words)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words from here to the end of the text
    total = np.zeros(n, np.uint64)
    for k in range(SIZE):
        total += np.where(left > k, h[k:k + n] * FACTORS[k], np.uint64(0))
    first = left == np.repeat(counts, counts)
    whole = np.minimum(np.repeat(counts, counts), SIZE).astype(np.uint64)  # keeps short sequences apart from longer ones
    keep = (left >= SIZE) | first
    return mixed(total + whole * np.uint64(0x9FB21C651E98DF25))[keep], owner[keep]


def distinct_sets(hashes: np.ndarray, owner: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes side by side, in order of (rank, hash)."""
    order = np.lexsort((hashes, owner) if rank is None else (hashes, rank, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]
