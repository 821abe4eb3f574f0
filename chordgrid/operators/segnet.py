"""The segmentation network's forward pass: linear layers, batch norms over all rows, mean pool, head.

A layer is one pass in Arrow batches: it norms and cuts off what it reads by the moments of the layer before, multiplies by its
matrix, which is shipped once a task, and gathers the moments of what it writes, one row a task beside the results.
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

WIDTHS = (350, 32, 64, 128, 256)


def weights(widths: tuple[int, ...] = WIDTHS, classes: int = 10, seed: int = 3) -> list[np.ndarray]:
    """Matrices (out, in) of each layer and the head, normal with deviation 0.1, from a seed."""
    sizes = [*zip(widths[1:], widths[:-1]), (classes, widths[-1])]
    rng = np.random.default_rng(int.from_bytes(hashlib.md5(str(seed).encode()).digest()[:4], "little"))
    return [np.round(rng.normal(0, 0.1, size), 6) for size in sizes]


@dataclass(frozen=True)
class Moments:
    """Mean and inverse deviation of each place over all rows."""

    mean: np.ndarray
    scale: np.ndarray


def _merged(parts: DataFrame, width: int, eps: float) -> Moments | None:
    """The moments of all rows from those of each task: rows, means, and squared deviations from the task's own mean, end to end."""
    parts = parts.select(F.col("x")[0].alias("n"), F.posexplode(F.arrays_zip(F.slice("x", 2, width).alias("mean"), F.slice("x", 2 + width, width).alias("off"))).alias("place", "m"))
    parts = parts.select("n", "place", "m.mean", "m.off")
    means = {r.place: r.mean for r in parts.groupBy("place").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean")).collect()}  # a row for each place
    if not means:
        return None
    mean = np.array([means[i] for i in range(width)])
    between = F.col("mean") - F.element_at(F.array(*[F.lit(float(m)) for m in mean]), F.col("place") + 1)
    spread = parts.groupBy("place").agg((F.sum(F.col("off") + F.col("n") * between * between) / F.sum("n")).alias("variance"))
    variance = {r.place: r.variance for r in spread.collect()}
    return Moments(mean, 1 / np.sqrt(np.array([variance[i] for i in range(width)]) + eps))


def _normed(rows: np.ndarray, norm: Moments | None) -> np.ndarray:
    return rows if norm is None else (rows - norm.mean) * norm.scale


def _arrays(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _listed(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def layer(df: DataFrame, matrix: np.ndarray | None, width: int, norm: Moments | None = None, *, cut: bool = False, eps: float = 1e-5) -> tuple[DataFrame, Moments | None]:
    """``df`` (imgid, x) normed, with ``cut`` without what is under 0, and multiplied, stored; and the result's moments.

    ``width`` is that of the result; without a ``matrix`` rows are kept as they are. The one pass over the rows gives both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, off = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _normed(_arrays(batch), norm)
            rows = np.maximum(rows, 0) if cut else rows
            rows = rows if matrix is None else rows @ matrix.T
            own, more = rows.mean(0), len(rows)
            off += ((rows - own) ** 2).sum(0) + (own - mean) ** 2 * (n * more / (n + more))
            mean += (own - mean) * (more / (n + more))
            n += more
            yield pa.RecordBatch.from_arrays([batch.column(0), _listed(rows), pa.array(np.zeros(more, bool))], names=["imgid", "x", "moments"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), _listed(np.concatenate([[n], mean, off])[None]), pa.array([True])], names=["imgid", "x", "moments"])

    both = stored(df.select("imgid", "x").mapInArrow(run, "imgid long, x array<double>, moments boolean"), "layer", by="moments")
    return both.where(~F.col("moments")).select("imgid", "x"), _merged(both.where("moments"), width, eps)


def mapped(df: DataFrame, matrix: np.ndarray | None, norm: Moments | None, *, before: bool = False, after: bool = False) -> DataFrame:
    """``df`` (imgid, x) normed and multiplied, without storing; what is under 0 is cut off before or after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _normed(_arrays(batch), norm) if batch.num_rows else np.zeros((0, 1))
            rows = np.maximum(rows, 0) if before else rows
            rows = rows @ matrix.T if matrix is not None and batch.num_rows else rows
            yield pa.RecordBatch.from_arrays([batch.column(0), _listed(np.maximum(rows, 0) if after else rows)], names=["imgid", "x"])

    return df.select("imgid", "x").mapInArrow(run, "imgid long, x array<double>")


def mean_pool(df: DataFrame, images: DataFrame, width: int, column: str = "x") -> DataFrame:
    """(imgid, x): the mean array of each image; zeros for an image without rows."""
    means = df.groupBy("imgid").agg(F.array(*[F.avg(F.col(column)[i]) for i in range(width)]).alias(column))
    zeros = F.array_repeat(F.lit(0.0), width)
    return images.select("imgid").join(means, "imgid", "left").select("imgid", F.coalesce(column, zeros).alias(column))


def forward(packed: DataFrame, images: DataFrame, layers: list[np.ndarray]) -> DataFrame:
    """(imgid, x): class scores from components' packed features (imgid, x)."""
    norm = None
    for n, matrix in enumerate(layers[:-1]):
        packed, norm = layer(packed, matrix, len(matrix), norm, cut=n > 0)
    width = layers[-1].shape[1]
    pooled, norm = layer(mean_pool(mapped(packed, None, norm, before=True), images, width), None, width)
    return mapped(pooled, layers[-1], norm, after=True)
