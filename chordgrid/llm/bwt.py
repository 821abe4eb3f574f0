"""Sorted suffixes of byte strings, and merging of shards' Burrows-Wheeler transforms by interleave refinement."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` in the order of the next ``depth`` (or some more) symbols, ties by position; 0 ends a string."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    alive = np.ones(n, bool)  # what follows the end of a string doesn't count
    for i in range(8):
        symbol = padded[i : i + n]
        key = (key << np.uint64(8)) | np.where(alive, symbol, 0)
        alive &= symbol != 0
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols before the string's end
    order = np.argsort(key, kind="stable")
    done = 8
    while True:
        sorted_key = key[order]
        fresh = np.ones(n, bool)
        fresh[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if done >= depth or fresh.all():
            return order
        follow = np.zeros(n, np.int64)
        inside = np.flatnonzero(left >= done)
        follow[inside] = rank[inside + done]
        key = (rank << 32 | follow).astype(np.uint64)
        order = np.argsort(key, kind="stable")
        done *= 2


def transform(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The symbol before each suffix in order; before a string's first symbol stands its end, 0."""
    before = np.empty_like(text)
    before[0], before[1:] = 0, text[:-1]
    return before[order]


def merge(transforms: list[np.ndarray], depth: int, drop_every: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that share their first ``depth`` symbols with another, in merged order, and the numbers of their intervals.

    A suffix is its place in the transforms laid end to end. Each round puts before every suffix the symbol that its
    shard's transform has for it, and sorts by that symbol alone, keeping the order of the round before: after h rounds
    the interleaving is right for h symbols, and adjacent suffixes share h symbols where no round parted them. A
    suffix alone in its interval stays alone whatever comes before it, so it leaves the interleaving.
    """
    symbols = np.concatenate(transforms)
    step = np.empty(len(symbols), np.int64)  # from a suffix to the one that has one symbol more before it
    start = 0
    for own in transforms:
        step[start + np.argsort(own, kind="stable")] = start + np.arange(len(own))
        start += len(own)
    at, interval = np.arange(len(symbols)), np.zeros(len(symbols), np.int32)
    for n in range(1, depth + 1):
        symbol = symbols[at]
        order = np.argsort(symbol, kind="stable")
        at, interval, symbol = step[at[order]], interval[order], symbol[order]
        parted = np.ones(len(at) + 1, bool)
        parted[1:-1] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1]) | (symbol[1:] == 0)
        interval = np.cumsum(parted[:-1], dtype=np.int32)
        if n % drop_every == 0 or n == depth:
            shared = ~(parted[:-1] & parted[1:])
            at, interval = at[shared], interval[shared]
    return at, interval
