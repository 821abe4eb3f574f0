"""Suffix-array deduplication: removes every byte that a 100-byte string covers which also starts earlier.

A window of 100 bytes has one anchor, the place of its least 50-byte hash, so equal windows have equal anchors at the
same place. A document's windows with one anchor follow each other and make a run. Runs meet by anchor; those whose
bytes equal an earlier run's are repeats as a whole. Where different runs share an anchor, the shards' suffixes are
sorted, their Burrows-Wheeler transforms merged by interleave refinement, and the merged intervals of 100 common bytes
tell which windows repeat. Nothing but runs that may repeat is ever sorted, and no window leaves its anchor's task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chordgrid.llm import bwt
from chordgrid.llm.batches import whole
from chordgrid.llm.common import RID, numbered, shuffle_partitions, stored, text_of
from chordgrid.llm.shingles import mixed

WINDOW = 100
GRAM = 50
#: Windows that are hashed at a time, which bounds the memory for a very long document.
CHUNK = 1 << 20
#: Runs that meet at a time, of whole anchors.
MET_ROWS = 1 << 17
#: Bytes of runs whose suffixes are merged at a time, and the number of their shards.
SORTED_BYTES, SHARDS = 1 << 19, 4

_ODD = [np.uint64(n) for n in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD[0])


def _power_hashes(data: np.ndarray, most: int) -> list[np.ndarray]:
    """Hashes of all strings of 1, 2, 4, ... up to 2**most bytes."""
    out = [_BYTES[data]]
    for level in range(most):
        half = 1 << level
        last = out[-1]
        if len(last) <= half:
            break
        out.append((last[:-half] ^ (last[:-half] >> np.uint64(29))) * _ODD[level] + last[half:])
    return out


def runs(data: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, content hash, first window, windows, anchor's place) of each run of windows with one anchor."""
    whole = np.frombuffer(data, np.uint8)
    for base in range(0, len(whole) - WINDOW + 1, CHUNK):
        part = whole[base : base + CHUNK + WINDOW - 1]
        h = _power_hashes(part, 6)
        n = len(part) - GRAM + 1
        gram = mixed(h[5][:n] * _ODD[5] + h[4][32 : 32 + n] * _ODD[6] + h[1][48 : 48 + n])
        low = np.uint64((1 << 24) - 1)
        key = (gram & ~low) | np.arange(n, dtype=np.uint64)
        span, width = WINDOW - GRAM + 1, 1
        least = key
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        windows = len(part) - WINDOW + 1
        anchor = (np.minimum(least[:windows], least[span - width : span - width + windows]) & low).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        count = np.diff(np.append(first, windows))
        place = anchor[first]
        end = first + count - 1 + WINDOW - 64  # where the run's last 64 bytes begin
        content = mixed(h[6][first] * _ODD[1] + h[6][(first + end) // 2] * _ODD[2] + h[6][end] * _ODD[3])
        content = mixed(content + (count * 64 + place - first).astype(np.uint64))
        yield gram[place], content, first + base, count, place + base


ROWS = "rid long, doc_id long, anchor long, content long, first int, windows int, place int, again boolean"


def anchored(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """All runs. Those that repeat one of the same batch are marked and leave their anchor, so that copies don't pile up there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in ROWS.split(", ")]
        for batch in batches:
            parts, size = [], 0
            for rid, key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for found in runs(value.as_py()):
                    n = len(found[0])
                    parts.append((np.full(n, rid), np.full(n, key), *found))
                    size += n
                    if size > 200_000:
                        yield _batch(parts, names)
                        parts, size = [], 0
            if parts:
                yield _batch(parts, names)

    # a null doc_id counts as larger than any other
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))
    source = df.select(F.col(RID).alias("rid"), key.alias("doc_id"), text_of(text).cast("binary").alias("text"))
    return source.mapInArrow(run, ROWS)


def _batch(parts: list, names: list[str]) -> pa.RecordBatch:
    rid, doc, anchor, content, first, windows, place = (np.concatenate([p[i] for p in parts]) for i in range(7))
    order = np.lexsort((first, rid, doc, content, anchor))
    again = np.zeros(len(rid), bool)
    again[order[1:]] = (anchor[order[1:]] == anchor[order[:-1]]) & (content[order[1:]] == content[order[:-1]])
    elsewhere = mixed(rid.astype(np.uint64) * _ODD[0] + first.astype(np.uint64))
    anchor = np.where(again, elsewhere, anchor)
    arrays = [pa.array(rid), pa.array(doc), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))]
    arrays += [pa.array(c.astype(np.int32)) for c in (first, windows, place)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(again)], names=names)


MET = "rid long, doc_id long, anchor long, first int, windows int, place int, open boolean"


def meetings(rows: DataFrame) -> DataFrame:
    """Runs that meet: those that repeat an earlier one's bytes (not open), and the first of each content where contents differ (open)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in MET.split(", ")]

        def found(rows: list[np.ndarray], opened: np.ndarray) -> pa.RecordBatch:
            arrays = [pa.array(c) for c in rows]
            return pa.RecordBatch.from_arrays([*arrays[:3], *[a.cast(pa.int32()) for a in arrays[3:]], pa.array(opened)], names=names)

        for table, _ in whole(batches, ("anchor",), MET_ROWS):
            *columns, again = (table.column(i).to_numpy() for i in range(8))
            again = again.astype(bool)
            yield found([columns[i][again] for i in (0, 1, 2, 4, 5, 6)], np.zeros(int(again.sum()), bool))
            rid, doc, anchor, content, first, windows, place = (c[~again] for c in columns)
            # only anchors that occur twice need an order; equal anchors follow each other
            twice = np.zeros(len(anchor) + 1, bool)
            twice[1:-1] = anchor[1:] == anchor[:-1]
            order = np.flatnonzero(twice[1:] | twice[:-1])
            order = order[np.lexsort((first[order], rid[order], doc[order], content[order], anchor[order]))]
            rid, doc, anchor, content, first, windows, place = (c[order] for c in (rid, doc, anchor, content, first, windows, place))
            n = len(rid)
            new_anchor, fresh = np.ones(n, bool), np.ones(n, bool)
            new_anchor[1:] = anchor[1:] != anchor[:-1]
            fresh[1:] = new_anchor[1:] | (content[1:] != content[:-1])
            group = np.cumsum(new_anchor) - 1
            contents = np.bincount(group, weights=fresh, minlength=1)[group] if n else np.zeros(0)
            keep = ~fresh | (contents > 1)
            yield found([c[keep] for c in (rid, doc, anchor, first, windows, place)], fresh[keep])

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(meet, MET)


def snippets(df: DataFrame, met: DataFrame, text: str) -> DataFrame:
    """The open runs with their bytes."""
    wanted = met.where("open").groupBy("rid").agg(F.collect_list(F.struct("anchor", "doc_id", "first", "windows")).alias("wanted"))
    texts = df.select(F.col(RID).alias("rid"), text_of(text).cast("binary").alias("text"))
    found = texts.join(wanted, "rid").select("rid", "text", F.explode("wanted").alias("w"))
    return found.select("w.anchor", "rid", "w.doc_id", "w.first", "w.windows", F.expr(f"substring(text, w.first + 1, w.windows + {WINDOW - 1})").alias("bytes"))


def repeats_among(table: dict[str, np.ndarray], pieces: list[bytes]) -> np.ndarray:
    """(row, window) of each window in ``pieces`` that also starts earlier among them, by merged transforms.

    Byte 0 ends a string, so bytes move up by one and 254 and 255, which UTF-8 never has, share a symbol.
    """
    up = np.minimum(np.arange(256) + 1, 255).astype(np.uint8)
    shards = min(SHARDS, len(pieces))
    texts, orders, owners, places = [], [], [], []
    for s in range(shards):
        rows = range(s, len(pieces), shards)
        texts.append(np.concatenate([np.append(up[np.frombuffer(pieces[r], np.uint8)], np.uint8(0)) for r in rows]))
        lengths = np.array([len(pieces[r]) + 1 for r in rows])
        owners.append(np.repeat(np.array(rows), lengths))
        places.append(np.concatenate([np.arange(n) for n in lengths]))
        orders.append(bwt.suffix_order(texts[-1], WINDOW))
    at, interval = bwt.merge([bwt.transform(t, o) for t, o in zip(texts, orders)], WINDOW)
    owner = np.concatenate([own[order] for own, order in zip(owners, orders)])[at]
    place = np.concatenate([own[order] for own, order in zip(places, orders)])[at]
    window = place < table["windows"][owner]  # a start that the run owns, with all its bytes before the end
    owner, place, interval = owner[window], place[window], interval[window]
    start = table["first"][owner] + place
    order = np.lexsort((start, table["rid"][owner], table["doc_id"][owner], interval))
    owner, place, interval = owner[order], place[order], interval[order]
    again = np.zeros(len(owner), bool)
    again[1:] = interval[1:] == interval[:-1]
    return np.stack((owner[again], place[again]), axis=1)


def merged_repeats(cut: DataFrame) -> DataFrame:
    """(rid, first, windows): stretches of windows that start earlier within another run of the same anchor."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole(batches, ("anchor",), SORTED_BYTES // (WINDOW + GRAM)):
            yield done(table)

    def done(table: pa.Table) -> pa.RecordBatch:
        columns = {name: table.column(name).to_numpy() for name in ("rid", "doc_id", "first", "windows")}
        found = repeats_among(columns, table.column("bytes").to_pylist())
        rid, start = columns["rid"][found[:, 0]], columns["first"][found[:, 0]] + found[:, 1]
        order = np.lexsort((start, rid))
        rid, start = rid[order], start[order]
        fresh = np.ones(len(rid), bool)
        fresh[1:] = (rid[1:] != rid[:-1]) | (start[1:] != start[:-1] + 1)
        at = np.flatnonzero(fresh)
        count = np.diff(np.append(at, len(rid)))
        return pa.RecordBatch.from_arrays([pa.array(rid[at]), pa.array(start[at].astype(np.int32)), pa.array(count.astype(np.int32))], names=["rid", "first", "windows"])

    dealt = cut.repartition(shuffle_partitions(cut.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(compare, "rid long, first int, windows int")


OUT = "rid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, spans array<struct<first: long, length: long>>"


def remove_repeats(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """rid, doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_sha256, spans for each row of ``df``.

    Null and empty texts, and those under 100 bytes, lose nothing. Earlier means a smaller doc_id (null counts as the
    largest), of equal doc_ids the row that stands first in the table, in one text the earlier start; repeated rows are documents of
    their own. Very long texts are read whole, in chunks of windows. Other columns are not read; an empty table gives an
    empty result. Runs count as equal when
    two 64-bit hashes agree.
    """
    df = numbered(df)
    met = stored(meetings(anchored(df, doc_id, text)), "spans-met")
    again = merged_repeats(snippets(df, met, text))
    gone = again.unionByName(met.where("not open").select("rid", "first", "windows"))
    gone = gone.groupBy("rid").agg(F.collect_list(F.struct("first", "windows")).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans"]
        for batch in batches:
            rows = []
            for value, gone in zip(batch.column(2), batch.column(3)):
                data = np.frombuffer(value.as_py(), np.uint8)
                change = np.zeros(len(data) + 1, np.int32)
                if gone.is_valid:
                    first, windows = (gone.values.field(i).to_numpy() for i in range(2))
                    np.add.at(change, first, 1)
                    np.add.at(change, first + windows - 1 + WINDOW, -1)
                covered = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False]))))
                kept = data[~covered].tobytes()
                spans = [{"first": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2])]
                rows.append((len(data), int(covered.sum()), len(spans), kept, hashlib.sha256(kept).hexdigest(), spans))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64())]))]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    texts = df.select(F.col(RID).alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("text"))
    return texts.join(gone, "rid", "left").select("rid", "doc_id", "text", "gone").mapInArrow(cut, OUT)
