"""Rounds of merging whole images in a task: blocks of images as arrays, pairs of ends in pieces.

Ends that share a place are looked at together, so distances are taken between places alone. A first pass goes through all
rounds but the last and counts what the last one has to compare; images are dealt out by that, and one with many pairs is
dealt into parts that each grow its strings again and take a share of the last round's pairs. Images whose strings don't
fit a task are named by the first pass; they are left to joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chordgrid.operators.storage import stored

_HALF = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
_PLACES = ("lf_y", "lf_x", "rt_y", "rt_x")
#: Strings of a block, pairs that are looked at together, and pairs of a task in the last round.
_BLOCK, _PIECE, _SHARE = 5_000, 1 << 16, 20_000_000
#: Coordinates beyond this go by joins, as cells are counted in 64 bits.
_FAR = float(1 << 20)


@dataclass(frozen=True)
class Limits:
    """Images of more than ``whole`` strings, or more than ``most`` pairs in a round before the last, don't fit a task."""

    whole: int = 1_000
    most: int = 500_000
    share: int = _SHARE


@dataclass(frozen=True)
class Merging:
    """How strings merge: the rounds' radii, and what ``strings.merged`` is told."""

    radii: tuple[float, ...]
    coincident: float
    inclusive: bool = True
    corrected: bool = False


class Rows:
    """Ends in the order of their places, and for each the ranges of ends within ``radius`` that follow; each pair once."""

    def __init__(self, unit: np.ndarray, y: np.ndarray, x: np.ndarray, radius: float, inclusive: bool) -> None:
        self.order = np.lexsort((x, y, unit))
        unit, y, x = unit[self.order], y[self.order], x[self.order]
        fresh = np.ones(len(y), bool)
        fresh[1:] = (unit[1:] != unit[:-1]) | (y[1:] != y[:-1]) | (x[1:] != x[:-1])
        start = np.flatnonzero(fresh)
        stop = np.append(start[1:], len(y))
        place_unit, y, x = unit[start], y[start], x[start]
        cy, cx = (np.floor(c / radius).astype(np.int64) for c in (y, x))
        cy, cx = cy - cy.min(), cx - cx.min() + 1
        wide = cx.max() + 2
        key = (place_unit * (cy.max() + 2) + cy) * wide + cx
        by = np.argsort(key, kind="stable")
        key = key[by]
        limit, each = radius * radius, np.arange(len(key))
        p, q = [], []
        for a, b in _HALF:
            sought = key + (a * wide + b)
            low = each + 1 if (a, b) == (0, 0) else np.searchsorted(key, sought, "left")
            i, j = spread(each, low, np.searchsorted(key, sought, "right"))
            i, j = by[i], by[j]
            squared = (y[i] - y[j]) * (y[i] - y[j]) + (x[i] - x[j]) * (x[i] - x[j])
            near = squared <= limit if inclusive else squared < limit
            p.append(i[near])
            q.append(j[near])
        p, q = np.concatenate(p), np.concatenate(q)
        of, first = spread(np.arange(len(p)), start[p], stop[p])
        own = np.arange(len(unit))
        self.first = np.concatenate([own, first])
        self.low = np.concatenate([own + 1, start[q][of]])
        self.high = np.concatenate([np.repeat(stop, stop - start), stop[q][of]])
        self.unit = unit[self.first]
        self.place = self.first - np.searchsorted(unit, self.unit)  # the end's number in its unit, whatever else the block holds

    def taken(self, mine: np.ndarray) -> None:
        """Only these rows stay."""
        self.first, self.low, self.high, self.unit, self.place = (c[mine] for c in (self.first, self.low, self.high, self.unit, self.place))

    def counts(self, units: int) -> np.ndarray:
        """Pairs of each unit."""
        return np.bincount(self.unit, weights=self.high - self.low, minlength=units).astype(np.int64)

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs as numbers in the order of places."""
        ends = np.cumsum(self.high - self.low)
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PIECE, "right")))
            yield spread(self.first[at:to], self.low[at:to], self.high[at:to])
            at = to


def spread(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value as often as its range is long, and the numbers of the ranges."""
    size = high - low
    return np.repeat(values, size), np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)


def _far(a: np.ndarray, b: np.ndarray, corrected: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ends that a merged string spans; ends are numbered 2 * string + side."""
    if corrected:
        return a ^ 1, b ^ 1
    return (a & ~1) | (b & 1), (b & ~1) | (a & 1)


def _length(y: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dy, dx = y[a] - y[b], x[a] - x[b]
    return np.sqrt(dy * dy + dx * dx)


def _area(y: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray, lf: np.ndarray, rt: np.ndarray) -> np.ndarray:
    """Twice the signed area of the far ends and the middle of the close ones."""
    t_y, t_x = (y[a] + y[b]) / 2, (x[a] + x[b]) / 2
    return (x[rt] - x[lf]) * (y[lf] - t_y) - (x[lf] - t_x) * (y[rt] - y[lf])


def _joined(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    return np.concatenate([old, new])


@dataclass
class Block:
    """Units (images, or parts of them) with their strings; strings of a unit are in the order of their numbers."""

    unit: np.ndarray
    y: np.ndarray
    x: np.ndarray
    dev: np.ndarray
    units: int

    @property
    def ends(self) -> np.ndarray:
        return np.repeat(self.unit, 2)

    def rows(self, radius: float, inclusive: bool) -> Rows:
        return Rows(self.ends, self.y, self.x, radius, inclusive)


@dataclass
class Trees(Block):
    """Strings that grow as trees. Two families meet if and only if their roots do, for a family has its members' roots; marks have a bit for each root."""

    marks: list[np.ndarray]
    size: np.ndarray

    @staticmethod
    def of(unit: np.ndarray, table: dict[str, np.ndarray], units: int) -> Trees:
        place = np.arange(len(unit)) - np.searchsorted(unit, unit)
        words = int(place.max()) // 64 + 1
        marks = [np.where(place // 64 == w, np.uint64(1) << (place % 64).astype(np.uint64), np.uint64(0)) for w in range(words)]
        return Trees(unit, *_ends(table), table["dev"], units, marks, np.ones(len(unit), np.int64))

    def pairs(self, rows: Rows, how: Merging) -> Iterator[tuple[np.ndarray, ...]]:
        """Ends a and b, far ends and the length, of pairs whose families don't meet and that give a string."""
        marks = [m[rows.order >> 1] for m in self.marks]
        for first, second in rows.pieces():
            apart = (marks[0][first] & marks[0][second]) == 0
            for m in marks[1:]:
                apart &= (m[first] & m[second]) == 0
            one, other = rows.order[first[apart]], rows.order[second[apart]]
            a, b = np.minimum(one, other), np.maximum(one, other)
            lf, rt = _far(a, b, how.corrected)
            length = _length(self.y, self.x, lf, rt)
            long = length > how.coincident
            yield tuple(c if long.all() else c[long] for c in (a, b, lf, rt, length))

    def grow(self, rows: Rows, how: Merging) -> int:
        """With the strings of a round, which come after those before; their first number."""
        before = len(self.unit)
        found = [np.concatenate(c) for c in zip(*[(a, b, lf, rt, length) for a, b, lf, rt, length in self.pairs(rows, how)])]
        a, b, lf, rt, length = found if found else [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
        by = np.lexsort((b, a))
        a, b, lf, rt, length = a[by], b[by], lf[by], rt[by], length[by]
        self.dev = _joined(self.dev, _area(self.y, self.x, a, b, lf, rt) / (length * length))
        self.y, self.x = (_joined(c, np.stack([c[lf], c[rt]], 1).ravel()) for c in (self.y, self.x))
        self.marks = [_joined(m, m[a >> 1] | m[b >> 1]) for m in self.marks]
        self.size = _joined(self.size, self.size[a >> 1] + self.size[b >> 1] + 1)
        self.unit = _joined(self.unit, self.unit[a >> 1])
        return before


@dataclass
class Scored(Block):
    """Strings in whose place those come that score; they are known by name."""

    n_y: np.ndarray
    n_x: np.ndarray
    names: list[str]

    @staticmethod
    def of(unit: np.ndarray, table: dict[str, np.ndarray], units: int) -> Scored:
        return Scored(unit, *_ends(table), table["dev"], units, table["n_y"], table["n_x"], table["sid"].tolist())

    def pairs(self, rows: Rows, how: Merging) -> Iterator[tuple[np.ndarray, ...]]:
        """Ends a and b of pairs that give a string that scores, and its seven values; a's end comes first by its name."""
        named = np.array([f"{n}/{side}".encode() for n in self.names for side in (0, 1)])
        rank = np.empty(len(named), np.int64)
        rank[np.argsort(named, kind="stable")] = np.arange(len(named))
        own = np.arange(len(self.unit)) * 2
        lengths = _length(self.y, self.x, own, own + 1)
        under, under_dev = lengths + 1e-3, self.dev + 1e-3
        for first, second in rows.pieces():
            one, other = rows.order[first], rows.order[second]
            turned = rank[one] > rank[other]
            a, b = np.where(turned, other, one), np.where(turned, one, other)
            lf, rt = _far(a, b, how.corrected)
            s, t = a >> 1, b >> 1
            length = _length(self.y, self.x, lf, rt)
            n_y, n_x = self.n_y[s] - self.n_y[t], self.n_x[s] - self.n_x[t]
            with np.errstate(all="ignore"):
                score = self.dev[s] / under_dev[t] + lengths[s] / under[t] + np.sqrt(n_y * n_y + n_x * n_x)
            kept = np.flatnonzero((length > how.coincident) & (score > 1) & (under_dev[t] != 0))
            a, b, lf, rt, length, s, t = (c[kept] for c in (a, b, lf, rt, length, s, t))
            lf_y, lf_x, rt_y, rt_x = self.y[lf], self.x[lf], self.y[rt], self.x[rt]
            new_y, new_x = (rt_x - lf_x) / length, -(rt_y - lf_y) / length
            m_y, m_x = (self.n_y[s] + self.n_y[t]) / 2, (self.n_x[s] + self.n_x[t]) / 2
            with np.errstate(all="ignore"):
                size = np.sqrt(m_y * m_y + m_x * m_x)
                off_y, off_x = m_y / size - new_y, m_x / size - new_x
                side = np.where(np.sqrt(off_y * off_y + off_x * off_x) < np.sqrt(2), 1.0, -1.0)
            yield a, b, lf_y, lf_x, rt_y, rt_x, side * new_y, side * new_x, _area(self.y, self.x, a, b, lf, rt) / length

    def made(self) -> tuple[pa.Array, pa.Array]:
        """What ends give to the name of a string, as its first and its second."""
        ends = [f"{n}|{side}" for n in self.names for side in (0, 1)]
        return pa.array([f"{e}|" for e in ends], pa.string()), pa.array(ends, pa.string())

    def grow(self, rows: Rows, how: Merging) -> int:
        first, second = self.made()
        found = [(self.unit[a >> 1], *values, pc.binary_join_element_wise(first.take(pa.array(a)), second.take(pa.array(b)), "").to_pylist()) for a, b, *values in self.pairs(rows, how)]
        unit, lf_y, lf_x, rt_y, rt_x, n_y, n_x, dev, made = zip(*found) if found else ([],) * 9
        joined = lambda parts: np.concatenate([np.zeros(0), *parts])
        unit = joined(unit).astype(np.int64)
        names = [hashlib.md5(m.encode()).hexdigest() for part in made for m in part]
        by = np.argsort(unit, kind="stable")
        self.unit, self.names = unit[by], [names[i] for i in by]
        self.y, self.x = (np.stack([joined(lf)[by], joined(rt)[by]], 1).ravel() for lf, rt in ((lf_y, rt_y), (lf_x, rt_x)))
        self.n_y, self.n_x, self.dev = (joined(c)[by] for c in (n_y, n_x, dev))
        return 0


def _ends(table: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.stack([table[f"lf_{c}"], table[f"rt_{c}"]], 1).ravel() for c in "yx")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Whole units (imgid, part), which come one after another: their rows, each row's unit, and the row at which a unit begins.

    Units of a block have equally many words of roots.
    """
    waiting: list[pa.Table] = []
    many = 0

    def cut(table: pa.Table, ended: bool) -> tuple[list, pa.Table]:
        image, part = (table.column(c).to_numpy() for c in ("imgid", "part"))
        begin = np.flatnonzero(np.append(True, (image[1:] != image[:-1]) | (part[1:] != part[:-1])))
        whole = begin if ended else begin[:-1]
        size = np.diff(np.append(begin, len(image)))[: len(whole)]
        found = []
        for words in np.unique((size - 1) // 64):
            mine = np.flatnonzero((size - 1) // 64 == words)
            rows = spread(mine, whole[mine], whole[mine] + size[mine])[1]
            starts = np.cumsum(size[mine]) - size[mine]
            found.append((table.take(pa.array(rows)), np.repeat(np.arange(len(mine)), size[mine]), starts))
        return found, table.slice(begin[-1]) if not ended else table.slice(len(image))

    for batch in batches:
        if batch.num_rows:
            waiting.append(pa.Table.from_batches([batch]))
            many += batch.num_rows
        if many >= _BLOCK:
            found, rest = cut(pa.concat_tables(waiting).combine_chunks(), False)
            yield from found
            waiting, many = [rest], rest.num_rows
    if many:
        yield from cut(pa.concat_tables(waiting).combine_chunks(), True)[0]


class _Crowded(Exception):
    """A block of several units has too many pairs in a round before the last."""


def _halved(batches: Iterator[pa.RecordBatch], grow: Callable) -> Iterator[tuple]:
    """(table, starts, what ``grow`` makes of it) of blocks, which are halved as long as they are crowded."""
    for block in _blocks(batches):
        waiting = [block]
        while waiting:
            table, unit, starts = waiting.pop()
            try:
                yield table, starts, grow(table, unit, starts)
            except _Crowded:
                half = len(starts) // 2
                at = int(starts[half])
                waiting.append((table.slice(at), unit[at:] - half, starts[half:] - at))
                waiting.append((table.slice(0, at), unit[:at], starts[:half]))


def _rows(block: Block, radius: float, how: Merging, limits: Limits) -> Rows:
    """Rows of a round before the last."""
    rows = block.rows(radius, how.inclusive)
    if block.units > 1 and (rows.high - rows.low).sum() > limits.most:
        raise _Crowded
    return rows


def _arrays(table: pa.Table, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {c: table.column(c).to_numpy() for c in names}


def _weights(kind: type, columns: tuple[str, ...], how: Merging, limits: Limits) -> Callable:
    """(imgid, pairs): what the last round has to compare; null where an image doesn't fit."""

    def grow(table: pa.Table, unit: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fits = np.ones(len(starts), bool)
        block = kind.of(unit, _arrays(table, columns), len(starts))
        for radius in how.radii[:-1]:
            if not len(block.unit):
                break
            rows = _rows(block, radius, how, limits)
            fits &= rows.counts(len(starts)) <= limits.most
            rows.taken(fits[rows.unit])
            block.grow(rows, how)
        return fits, block.rows(how.radii[-1], how.inclusive).counts(len(starts)) if len(block.unit) else np.zeros(len(starts), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, (fits, left) in _halved(batches, grow):
            yield pa.RecordBatch.from_pydict({"imgid": table.column("imgid").to_numpy()[starts], "pairs": pa.array(left, mask=~fits)})

    return run


def dealt(strings: DataFrame, kind: type, how: Merging, limits: Limits) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``strings`` of images that fit a task, with part and parts, dealt out for the last round; and those of images that don't, if any.

    The first is for ``mapInArrow``; the second are images with their pairs.
    """
    # null and NaN are far too
    far = F.coalesce(sum(F.abs(c) for c in _PLACES), F.lit(float("inf")))
    sizes = strings.groupBy("imgid").agg(F.count("*").alias("n"), F.max(far).alias("far"))
    small = sizes.where((F.col("n") <= limits.whole) & (F.col("far") <= _FAR)).select("imgid")
    columns = ("dev", "n_y", "n_x", "sid", *_PLACES) if kind is Scored else ("dev", *_PLACES)
    own = strings.join(small, "imgid", "left_semi").select("imgid", F.lit(0).alias("part"), F.lit(1).alias("parts"), "sid", *[c for c in columns if c != "sid"])
    count = strings.count()
    dense = own.repartition(max(1, -(-count // _BLOCK)), "imgid").sortWithinPartitions("imgid", "sid")
    weights = stored(dense.mapInArrow(_weights(kind, columns, how, limits), f"imgid {dict(strings.dtypes)['imgid']}, pairs long"), "string-pairs")
    fitting = weights.where("pairs is not null")
    total = fitting.agg(F.sum("pairs")).first()[0] or 0
    parts = F.greatest(F.lit(1), F.ceil(F.col("pairs") / limits.share)).cast("int")
    share = fitting.select("imgid", parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    tasks = max(1, -(-total // limits.share), min(-(-count // 1_000), strings.sparkSession.sparkContext.defaultParallelism * 4))
    own = own.drop("part", "parts").join(share, "imgid").repartition(tasks, "imgid", "part").sortWithinPartitions("imgid", "part", "sid")
    apart = strings.join(fitting.select("imgid"), "imgid", "left_anti")
    return own, fitting, None if apart.isEmpty() else apart


def _last(block: Block, how: Merging, part: np.ndarray, parts: np.ndarray) -> Rows:
    """Rows of the last round; where an image has parts, each takes the rows of every so many of its ends."""
    rows = block.rows(how.radii[-1], how.inclusive)
    if (parts > 1).any():
        rows.taken(rows.place % parts[rows.unit] == part[rows.unit])
    return rows


SUMS = "round int, n_strings long, n_ancestors long, bent_left long, bent_right long, places double"


def forest_sums(how: Merging, limits: Limits) -> Callable:
    """(imgid, SUMS) of dealt strings: for each unit and round what its strings add up to."""
    names = ("n_strings", "n_ancestors", "bent_left", "bent_right")

    def sums(units: int, of: np.ndarray, ancestors: np.ndarray, dev: np.ndarray, lf_y: np.ndarray, lf_x: np.ndarray, rt_y: np.ndarray, rt_x: np.ndarray) -> np.ndarray:
        columns = (np.ones(len(of)), ancestors, dev > 0, dev < 0, lf_y + 2 * lf_x + 3 * rt_y + 5 * rt_x)
        return np.stack([np.bincount(of, weights=c, minlength=units) for c in columns]).astype(float)  # whole numbers where there are no rows

    def grow(table: pa.Table, unit: np.ndarray, starts: np.ndarray) -> tuple[Trees, list[np.ndarray]]:
        trees = Trees.of(unit, _arrays(table, ("dev", *_PLACES)), len(starts))
        part = table.column("part").to_numpy()[starts]
        begin, found = 0, []
        for radius in (*how.radii[:-1], None):
            mine = np.flatnonzero(part[trees.unit[begin:]] == 0) + begin  # other parts grow them too
            left, right = 2 * mine, 2 * mine + 1
            found.append(sums(len(starts), trees.unit[mine], trees.size[mine] - 1, trees.dev[mine], trees.y[left], trees.x[left], trees.y[right], trees.x[right]))
            if radius is not None:
                begin = trees.grow(_rows(trees, radius, how, limits), how)
        return trees, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, (trees, found) in _halved(batches, grow):
            image, part, parts = (table.column(c).to_numpy()[starts] for c in ("imgid", "part", "parts"))
            total = np.zeros((5, len(starts)))
            for a, b, lf, rt, length in trees.pairs(_last(trees, how, part, parts), how):
                dev = _area(trees.y, trees.x, a, b, lf, rt) / (length * length)
                total += sums(len(starts), trees.unit[a >> 1], trees.size[a >> 1] + trees.size[b >> 1], dev, trees.y[lf], trees.x[lf], trees.y[rt], trees.x[rt])
            for n, each in enumerate([*found, total]):
                has = np.flatnonzero(each[0])
                counted = {k: c[has].astype(np.int64) for k, c in zip(names, each)}
                yield pa.RecordBatch.from_pydict({"imgid": image[has], "round": np.full(len(has), n, np.int32)} | counted | {"places": each[4][has]})

    return run


def scored_rounds(how: Merging, limits: Limits) -> Callable:
    """(imgid, made, the seven values) of the last round's strings; made is the text whose hash names one."""
    names = (*_PLACES, "n_y", "n_x", "dev")

    def grow(table: pa.Table, unit: np.ndarray, starts: np.ndarray) -> Scored:
        block = Scored.of(unit, _arrays(table, ("dev", "n_y", "n_x", "sid", *_PLACES)), len(starts))
        for radius in how.radii[:-1]:
            if len(block.unit):
                block.grow(_rows(block, radius, how, limits), how)
        return block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, block in _halved(batches, grow):
            if not len(block.unit):
                continue
            image, part, parts = (table.column(c).to_numpy()[starts] for c in ("imgid", "part", "parts"))
            first, second = block.made()
            for a, b, *values in block.pairs(_last(block, how, part, parts), how):
                made = pc.binary_join_element_wise(first.take(pa.array(a)), second.take(pa.array(b)), "")
                yield pa.RecordBatch.from_pydict({"imgid": image[block.unit[a >> 1]], "made": made} | dict(zip(names, values)))

    return run
