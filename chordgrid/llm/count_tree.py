"""An R-tree over group-count vectors, searched for each point's best partners by an upper bound on overlaps.

A point is a set's number of members in each of its hash groups, so the sum of the smaller counts of two points bounds
the overlap of their sets, and the sum over the upper corners of two boxes bounds that of any points in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN = 16
#: Coordinates of boxes and of the first look at a pair; finer ones add up to them, so their bound holds as well.
COARSE = 32
#: Coordinates that are compared at a time, which bounds the memory of a search.
STEP = 1 << 22


def enough(overlap: np.ndarray, sizes: np.ndarray, similarity: int = 90) -> np.ndarray:
    """Whether an overlap can reach ``similarity`` of 100 of the union of sets whose sizes add up to ``sizes``."""
    return (100 + similarity) * overlap >= similarity * sizes


def overlaps(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The summed minima of pairs of points."""
    out = np.empty(len(a), np.int64)
    step = max(1, STEP // max(1, points.shape[1]))
    for start in range(0, len(a), step):
        part = slice(start, start + step)
        out[part] = np.minimum(points[a[part]], points[b[part]]).sum(axis=1, dtype=np.int64)
    return out


class CountTree:
    """Points in order of size, packed into boxes of FAN, those into boxes of FAN, up to one."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.points, self.sizes = points, sizes
        self.coarse = points.reshape(len(points), -1, min(COARSE, points.shape[1])).sum(axis=1, dtype=np.uint16)
        self.order = np.lexsort((self.coarse.argmax(axis=1), sizes))
        tops, least = [self.coarse[self.order]], [sizes[self.order]]
        while len(tops[-1]) > 1:
            starts = np.arange(0, len(tops[-1]), FAN)
            tops.append(np.maximum.reduceat(tops[-1], starts))
            least.append(np.minimum.reduceat(least[-1], starts))
        self.tops, self.least = tops, least  # by level, points first

    def near(self, top: np.ndarray, least: int, similarity: int) -> np.ndarray:
        """Positions of the points that a box with this upper corner and least size may have partners among."""
        at = np.zeros(1, np.int64)
        for level in range(len(self.tops) - 1, -1, -1):
            if level < len(self.tops) - 1:
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                at = at[at < len(self.tops[level])]
            overlap = np.concatenate([np.minimum(part, top).sum(axis=1, dtype=np.int64) for part in self._parts(self.tops[level], at)])
            at = at[enough(overlap, self.least[level][at] + least, similarity)]
            if not len(at):
                break
        return self.order[at]

    def _parts(self, corners: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        step = max(1, STEP // corners.shape[1])
        for start in range(0, max(1, len(at)), step):
            yield corners[at[start : start + step]]

    def pairs(self, other: CountTree, similarity: int = 90) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, overlap) for pairs of a point here and one of ``other`` whose bound is enough, a box at a time."""
        for start in range(0, len(self.order), FAN):
            own = self.order[start : start + FAN]
            found = other.near(self.coarse[own].max(axis=0), int(self.sizes[own].min()), similarity)
            i, j = np.repeat(own, len(found)), np.tile(found, len(own))
            for one, two in ((self.coarse, other.coarse), (self.points, other.points)):
                overlap = np.empty(len(i), np.int64)
                step = max(1, STEP // one.shape[1])
                for at in range(0, len(i), step):
                    part = slice(at, at + step)
                    overlap[part] = np.minimum(one[i[part]], two[j[part]]).sum(axis=1, dtype=np.int64)
                keep = enough(overlap, self.sizes[i] + other.sizes[j], similarity)
                i, j, overlap = i[keep], j[keep], overlap[keep]
            if len(i):
                yield i, j, overlap
