"""Product codes of vectors: integer codebooks by rounds of assignment and floored means, nearest entries by partial distances.

A round is one pass over the table. Each task adds up its parts by entry, Spark adds up the tasks, and the codebooks, parts
times entries small vectors of integers, are all that comes to the driver and goes out again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chordgrid.operators.storage import stored

#: Components of this size or more, as integers, would let squared distances of a part leave 64 bits.
LIMIT = 1 << 28
#: Labels whose sums are broadcast, counted first; more of them are joined by a shuffle.
BROADCAST_LABELS = 10_000


@dataclass(frozen=True)
class Codebooks:
    """``entries`` is (parts, entries, width) of integers."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        """Of the decimal components by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, the lower index of equals.

    ``parts`` is (width, rows), ``entries`` (entries, width), both 64-bit integers. Dimensions come in descending variance of
    the entries. Each row begins with the entry nearest in the first dimension; others add up their distance dimension by
    dimension, and a row leaves an entry once its sum exceeds the row's best complete distance.
    """
    count, width = entries.shape
    spread = [count * sum(c * c for c in column) - sum(column) ** 2 for column in entries.T.tolist()]
    order = sorted(range(width), key=lambda d: -spread[d])
    values, steps = parts[order], entries[:, order]
    line = np.argsort(steps[:, 0], kind="stable")
    middles = (steps[line, 0][1:] + steps[line, 0][:-1]) // 2
    index = line[np.searchsorted(middles, values[0])]
    best = np.zeros(values.shape[1], np.int64)
    for d in range(width):
        best += (values[d] - steps[index, d]) ** 2
    first = index.copy()
    for k in range(count):
        # the first entry's distance is known already
        total = (values[0] - steps[k, 0]) ** 2
        rows = np.flatnonzero((total <= best) & (first != k))
        total = total[rows]
        for d in range(1, width):
            if not len(rows):
                break
            total = total + (values[d, rows] - steps[k, d]) ** 2
            near = total <= best[rows]
            rows, total = rows[near], total[near]
        better = (total < best[rows]) | (k < index[rows])
        rows, total = rows[better], total[better]
        best[rows], index[rows] = total, k
    return index, best


def _integers(column: pa.Array, scale: float, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, (width, rows) integers) of a list column; rows with a null, a null component or one that isn't finite go."""
    column = column if isinstance(column, pa.ListArray) else column.cast(pa.list_(column.type.value_type))
    ends = column.offsets.to_numpy()
    sizes = np.diff(ends)
    held = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.values.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)  # nulls become NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    kept = np.flatnonzero(held & (bad[ends[1:]] == bad[ends[:-1]]))
    if width is None:
        width = int(sizes[kept[0]]) if len(kept) else 0
    if np.any(sizes[kept] != width):
        raise ValueError("vectors differ in length")
    if not len(kept) or not width:
        return kept, np.zeros((width, len(kept)), np.int64)
    values = np.floor(flat[ends[kept][:, None] + np.arange(width)] * scale)
    if np.abs(values).max() >= LIMIT:
        raise ValueError(f"components reach {LIMIT / scale}")
    return kept, np.ascontiguousarray(values.astype(np.int64).T)


def first_codebooks(vectors: DataFrame, *, vec_id: str, vector: str, parts: int, entries: int, scale: float) -> Codebooks | None:
    """The codebooks of the ``entries`` smallest kept ids, fewer where there are fewer vectors; None without any."""
    component = F.col("c")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    table = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & fine)
    rows = table.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not rows:
        return None
    if len({len(r.v) for r in rows}) > 1 or len(rows[0].v) % parts or not rows[0].v:
        raise ValueError(f"vectors are not of one length that {parts} divides")
    values = np.floor(np.array([r.v for r in rows], np.float64) * scale).astype(np.int64)
    return Codebooks(values.reshape(len(rows), parts, -1).transpose(1, 0, 2).copy())


def _sums(vectors: DataFrame, vector: str, books: Codebooks, scale: float) -> DataFrame:
    """(part, entry, n, sums): each task's parts added up by their nearest entry."""
    entries = books.entries
    n_parts, count, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(entries.shape, np.int64), np.zeros((n_parts, count), np.int64)
        for batch in batches:
            _, values = _integers(batch.column(0), scale, n_parts * width)
            for p in range(n_parts):
                part = values[p * width : (p + 1) * width]
                index, _ = nearest(part, entries[p])
                n[p] += np.bincount(index, minlength=count)
                for d in range(width):
                    # sums of one batch stay exact in the weights' 53 bits
                    sums[p, :, d] += np.bincount(index, part[d], minlength=count).astype(np.int64)
        p, k = np.nonzero(n)
        flat = pa.array(sums[p, k].ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(n[p, k]), pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * width), flat)],
            names=["part", "entry", "n", "sums"],
        )

    return vectors.select(vector).mapInArrow(run, "part int, entry int, n long, sums array<long>")


def trained(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0) -> Codebooks | None:
    """The codebooks after ``rounds`` rounds; an entry that is nearest to no part stays. None for a table without vectors."""
    books = first_codebooks(vectors, vec_id=vec_id, vector=vector, parts=parts, entries=entries, scale=scale)
    if books is None:
        return None
    width = books.entries.shape[2]
    for _ in range(rounds):
        sums = _sums(vectors, vector, books, scale)
        total = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(width)]
        found = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect()  # a row for each entry
        new = books.entries.copy()
        for row in found:
            new[row.part, row.entry] = [int(row[f"s{d}"]) // row.n for d in range(width)]
        if (new == books.entries).all():
            break  # what a round leaves as it was, all later ones do
        books = Codebooks(new)
    return books


def encoded(vectors: DataFrame, books: Codebooks, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 4096.0) -> DataFrame:
    """(vec_id, label, code, error) of each vector: two hex digits for each part's entry, and the squared distances' sum."""
    entries = books.entries
    n_parts, _, width = entries.shape
    digits = np.array([f"{k:02x}" for k in range(256)])
    if entries.shape[1] > 256:
        raise ValueError("two hex digits name at most 256 entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, values = _integers(batch.column(2), scale, n_parts * width)
            code, error = np.full(len(kept), "", dtype=f"<U{2 * n_parts}"), np.zeros(len(kept), np.int64)
            for p in range(n_parts):
                index, distance = nearest(values[p * width : (p + 1) * width], entries[p])
                code = np.char.add(code, digits[index])
                error += distance
            rows = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(code.tolist(), pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), vector)
    kind = given.schema["label"].dataType.simpleString()
    return given.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def compress(
    vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0
) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, code, error, label_error) of each kept vector, and the codebooks.

    Vectors that are null or hold a null or non-finite component are dropped; others must be of one length that ``parts``
    divides, with components under 65,536 at the given scale, else the job fails. Components become floor(scale * x).
    With fewer vectors than ``entries`` the codebooks are that short; ties of ids start by the vectors' order, a null id
    counts as the largest; repeated rows each give a row; ``label_error`` sums over equal labels, nulls together; columns
    besides the three aren't read, so their names can't clash; an empty table gives an empty result and no codebooks.
    """
    books = trained(vectors, vec_id=vec_id, vector=vector, parts=parts, entries=entries, rounds=rounds, scale=scale)
    if books is None:
        none = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none.where(F.lit(False)), None
    codes = stored(encoded(vectors, books, vec_id=vec_id, vector=vector, label=label, scale=scale), "codes")
    sums = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    joined = codes.join(sums, codes["label"].eqNullSafe(sums["of"]))
    return joined.select("vec_id", "code", "error", "label_error"), books
