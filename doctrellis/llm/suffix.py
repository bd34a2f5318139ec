"""Suffix arrays over many sequences at once, with numpy."""

from __future__ import annotations

import numpy as np


def suffix_ranks(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of sequences laid end to end, and the ranks after each doubling.

    ``owner`` (ascending) tells the sequence of a position; suffixes end with their sequence
    and are sorted within it.  Ranks of level k agree exactly where the next 2**k symbols do.
    Only positions that still share a rank are sorted again.
    """
    n = len(symbols)
    key = owner.astype(np.int64) * (int(symbols.max(initial=0)) + 1) + symbols
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.ones(n, bool)
    first[1:] = sorted_key[1:] != sorted_key[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    levels = [rank.copy()]
    slots = np.flatnonzero(~first | np.append(~first[1:], False))
    step = 1
    while len(slots):
        at = order[slots]
        ahead = at + step
        inside = ahead < n
        ahead[~inside] = 0
        follow = np.where(inside & (owner[ahead] == owner[at]), rank[ahead] + 1, 0)
        key = rank[at] * (n + 1) + follow
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[slots] = at
        first = np.ones(len(at), bool)
        first[1:] = key[1:] != key[:-1]
        rank[at] = slots[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        levels.append(rank.copy())
        slots = slots[~first | np.append(~first[1:], False)]
        step *= 2
    return order, levels


def adjacent_lcp(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in the suffix array."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    alike = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[alike - 1].copy(), order[alike].copy()
    found = np.zeros(len(alike), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside.copy()
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        found[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    lcp[alike] = found
    return lcp


def longest_repeat(symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each position, how many symbols from there occur elsewhere in the same sequence too."""
    if not len(symbols):
        return np.zeros(0, np.int64)
    order, levels = suffix_ranks(symbols, owner)
    lcp = adjacent_lcp(order, levels)
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    return out
