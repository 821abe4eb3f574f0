"""Raster values at places off the lattice: each place takes a weighted sum of the pixels around it.

A place knows its taps by arithmetic alone, so gathering is one equi-join of taps to pixels and one sum, whatever the image's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _taps(at: Column, mode: str) -> list[tuple[Column, Column]]:
    """(pixel, weight) along one axis."""
    if mode == "nearest":
        return [(F.rint(at), F.lit(1.0))]
    low = F.floor(at)
    d = at - low
    if mode == "bilinear":
        return [(low, 1 - d), (low + 1, d)]
    if mode != "bicubic":
        raise ValueError(mode)
    # cubic convolution with slope -1 at the neighbours
    return [(low - 1, -d * (1 - d) * (1 - d)), (low, 1 - d * d * (2 - d)), (low + 1, d * (1 + d * (1 - d))), (low + 2, -d * d * (1 - d))]


def gathered(raster: DataFrame, places: DataFrame, keys: tuple[str, ...], mode: str = "nearest", *, side: int | None = None, outside: float = 0.0) -> DataFrame:
    """(imgid, keys, v): the value of ``raster`` (imgid, y, x, v) at each of ``places`` (imgid, keys, y, x), which keys tell apart.

    ``mode`` is "nearest", where halves go to the even pixel, "bilinear" or "bicubic". Without ``side``, pixels that the raster
    lacks count as ``outside``. With it, pixels beyond the image's border repeat the border's, and a place that no
    pixel of the image covers is ``outside``.
    """
    column = {c: F.col(f"__{c}") for c in "yx"}
    given = places.select("imgid", *keys, *[F.col(c).cast("double").alias(f"__{c}") for c in "yx"])
    taps = F.array(*[F.struct(y.cast("long").alias("y"), x.cast("long").alias("x"), (wy * wx).alias("w")) for y, wy in _taps(column["y"], mode) for x, wx in _taps(column["x"], mode)])
    inside = F.lit(True)
    if side is not None:
        for c in column.values():
            inside &= (c >= -0.5) & (c < side - 0.5)
        taps = F.transform(taps, lambda t: F.struct(*[F.least(F.greatest(t[c], F.lit(0)), F.lit(side - 1)).cast("long").alias(c) for c in "yx"], t["w"].alias("w")))
    exploded = given.select("imgid", *keys, inside.alias("__inside"), F.explode(taps).alias("__t"))
    exploded = exploded.select("imgid", *keys, "__inside", F.col("__t.y").alias("__ty"), F.col("__t.x").alias("__tx"), F.col("__t.w").alias("__w"))
    values = raster.select("imgid", F.col("y").cast("long").alias("__ty"), F.col("x").cast("long").alias("__tx"), F.col("v").alias("__v"))
    met = exploded.join(values, ["imgid", "__ty", "__tx"], "left")
    summed = met.groupBy("imgid", *keys, "__inside").agg(F.sum(F.col("__w") * F.coalesce("__v", F.lit(outside))).alias("v"))
    return summed.select("imgid", *keys, F.when(F.col("__inside"), F.col("v")).otherwise(outside).alias("v"))
