"""Word shingles of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from chordgrid.llm.tokenizing import segments

_ODD = [np.uint64(n) for n in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash by word, computed once; emptied when it has ``most`` words."""

    def __init__(self, most: int = 400_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value

    def shingles(self, text: bytes, width: int) -> np.ndarray:
        """The distinct ``width``-word shingles of ``text`` with A-Z in lower case; fewer words are one shingle, none are none."""
        parts = []
        for segment in segments(text, 1 << 20):
            words = segment.lower().split()
            parts.append(np.fromiter(map(self.__getitem__, words), np.uint64, len(words)))
        h = np.concatenate(parts)
        if not len(h):
            return h
        n = max(1, len(h) - width + 1)
        x = np.full(n, min(len(h), width), np.uint64)
        for i in range(min(len(h), width)):
            x = mixed(x * _ODD[i % len(_ODD)] + h[i : i + n])
        return np.unique(x)
