"""Packing by multiway differencing (Karmarkar and Karp): near-equal windows, more of them while one overflows, cuts last."""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chordgrid.llm.batches import lean
from chordgrid.llm.common import text_of
from chordgrid.llm.tokenizing import WordEncoder, task_encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Positions of ``sizes`` in ``k`` groups of near-equal sums.

    A partial partition is k sums in falling order. The two with the largest spread merge, the largest sum of one
    with the smallest of the other, so that their imbalances cancel.
    """
    left, right = [], []  # a group is a leaf (a position) or a node over two groups
    n = len(sizes)
    heap = [(-s, i, None, None) for i, s in enumerate(sizes)]
    heapq.heapify(heap)

    def full(entry: tuple) -> tuple[np.ndarray, np.ndarray]:
        if entry[2] is not None:
            return entry[2], entry[3]
        sums, groups = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], groups[0] = sizes[entry[1]], entry[1]
        return sums, groups

    serial = n
    while len(heap) > 1:
        (a, ga), (b, gb) = full(heapq.heappop(heap)), full(heapq.heappop(heap))
        b, gb = b[::-1], gb[::-1]
        sums, groups = a + b, np.where(ga >= 0, ga, gb)
        both = np.flatnonzero((ga >= 0) & (gb >= 0))
        if len(both):
            groups[both] = n + len(left) + np.arange(len(both))
            left.extend(ga[both].tolist())
            right.extend(gb[both].tolist())
        order = np.argsort(-sums, kind="stable")
        sums, groups = sums[order], groups[order]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), serial, sums, groups))
        serial += 1
    out = []
    for group in full(heap[0])[1].tolist() if heap else []:
        found, todo = [], [group] if group >= 0 else []
        while todo:
            g = todo.pop()
            if g < n:
                found.append(g)
            else:
                todo += (left[g - n], right[g - n])
        out.append(sorted(found))
    return out


def fitted(sizes: list[int], capacity: int, loose: set[int] = frozenset(), padding: float = 0.1) -> list[list[tuple[int, int, int]]]:
    """Windows of (position, start, length) with sums of at most ``capacity``; sizes are at most that.

    Pieces are differenced whole into the least number of windows, and as long as one overflows, into a fiftieth more.
    Positions in ``loose`` may be cut: they fill the gaps that this leaves, then windows of their own. Where sizes can't go
    together (all a little over half a window), the number stops ``padding`` over the least, and what overflows is cut off too.
    """
    whole = [i for i in range(len(sizes)) if i not in loose]
    k = max(1, -(-sum(sizes[i] for i in whole) // capacity))
    most = k + math.ceil(k * padding)
    while True:
        groups = [[whole[j] for j in g] for g in differencing([sizes[i] for i in whole], k)]
        if k == most or all(sum(sizes[i] for i in g) <= capacity for g in groups):
            break
        k = min(most, k + max(1, k // 50))
    out, over = [], [(i, 0, sizes[i]) for i in sorted(loose)]
    for g in groups:
        window, room = [], capacity
        for i in sorted(g, key=lambda i: sizes[i]):  # the largest is the one that is cut
            length = min(room, sizes[i])
            if length:
                window.append((i, 0, length))
            if length < sizes[i]:
                over.append((i, length, sizes[i] - length))
            room -= length
        out.append((room, window))
    out.sort(key=lambda w: -w[0])
    over.sort(key=lambda piece: piece[2])
    out += [(capacity, []) for _ in range(-(-sum(length for _, _, length in over) // capacity))]
    for room, window in out:
        while room and over:
            i, start, length = over.pop()
            part = min(room, length)
            window.append((i, start, part))
            room -= part
            if part < length:
                over.append((i, start + part, length - part))
    return [window for _, window in out if window]


def pack(
    df: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 1, block_pieces: int = 2048
) -> DataFrame:
    """One row for each piece of each row's ids (with ``end_id`` appended): where it starts and where it lies.

    Every input partition packs its own rows, so nothing is shuffled: each full piece of ``capacity`` ids is a
    sequence, and rows that fit one, ``block_pieces`` at a time, are differenced whole into near-equal windows, whose number
    rises while one overflows; rests of longer rows fill the gaps (``fitted``). sequence_id is the partition's number times 2**40 plus a count. A null or empty
    text is the lone end id; a very long text is encoded whole, segment by segment; repeated rows are documents of their
    own; a null doc_id stays null; other columns are not read; an empty table gives an empty result. Ties in size keep
    input order, so a rerun over the same partitions gives the same rows.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_encoder(tokenizer) as ids_of:
            yield from packed(batches, ids_of)

    def packed(batches: Iterator[pa.RecordBatch], ids_of: WordEncoder) -> Iterator[pa.RecordBatch]:
        tail = np.uint32(end_id).tobytes()
        next_id = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []  # finished pieces
        rest: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of pieces that wait for their block

        def piece(key: int | None, start: int, ids: bytes, n: int, offset: int) -> tuple:
            return (key, start, len(ids) // 4, zlib.crc32(ids), n, next_id, offset)

        def close() -> None:
            nonlocal next_id
            loose = {i for i, (_, start, _, _) in enumerate(rest) if start}
            for window in fitted([len(ids) // 4 for _, _, ids, _ in rest], capacity, loose):
                offset = 0
                for i, at, length in window:
                    key, start, ids, n = rest[i]
                    rows.append(piece(key, start + at, ids[4 * at : 4 * (at + length)], n, offset))
                    offset += length
                next_id += 1
            rest.clear()

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            names = [field.split()[0] for field in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = ids_of.encode(value) + tail
                n = len(ids) // 4
                whole = n // capacity * capacity
                for start in range(0, whole, capacity):
                    rows.append(piece(key, start, ids[4 * start : 4 * (start + capacity)], n, 0))
                    next_id += 1
                if whole < n:
                    rest.append((key, whole, ids[4 * whole :], n))
                if len(rest) >= block_pieces:
                    close()
                if len(rows) >= 8192:
                    yield flushed()
        close()
        if rows:
            yield flushed()

    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("text"))
    return source.mapInArrow(run, SCHEMA)
