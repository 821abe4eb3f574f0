"""Resolution pyramids: levels of averaged pixels, nodes with parents on the next coarser level, and chords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chordgrid.functions.geometry import quarter_turn


def area_resize(pixels: DataFrame, factor: int, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """(imgid, y, x, values): means of ``factor`` by ``factor`` blocks."""
    block = [F.expr(f"cast(y div {factor} as long)").alias("y"), F.expr(f"cast(x div {factor} as long)").alias("x")]
    return pixels.groupBy("imgid", *block).agg(*[F.avg(v).alias(v) for v in values])


def bilinear_resize(pixels: DataFrame, side: int, target: int, limits: tuple[float, float] | None = None) -> DataFrame:
    """(imgid, y, x, v) on a ``target`` grid whose corners are the source's, from each target's four nearest sources, cut at ``limits``."""
    spark = pixels.sparkSession
    scale = (side - 1) / max(1, target - 1)
    axis = spark.range(target).select(F.col("id").alias("t"), (F.col("id") * scale).alias("s"))
    low = F.least(F.floor("s"), F.lit(max(0, side - 2)))
    taps = axis.select("t", F.explode(F.array(F.struct(low.alias("i"), (1 - (F.col("s") - low)).alias("w")), F.struct((low + 1).alias("i"), (F.col("s") - low).alias("w")))).alias("p"))
    taps = taps.select("t", "p.i", "p.w").where("w > 0")
    ty = taps.select(F.col("t").alias("ny"), F.col("i").alias("y"), F.col("w").alias("wy"))
    tx = taps.select(F.col("t").alias("nx"), F.col("i").alias("x"), F.col("w").alias("wx"))
    joined = pixels.join(F.broadcast(ty), "y").join(F.broadcast(tx), "x")  # two rows for each target row or column
    value = F.sum(F.col("v") * F.col("wy") * F.col("wx"))
    value = value if limits is None else F.least(F.greatest(value, F.lit(limits[0])), F.lit(limits[1]))
    return joined.groupBy("imgid", F.col("ny").alias("y"), F.col("nx").alias("x")).agg(value.alias("v"))


def nodes(levels: list[tuple[int, DataFrame]], images: int) -> DataFrame:
    """(imgid, level, linid, parent_linid, cy, cx, ny, nx, size) of the pixels with a value over 0, coarsest level first.

    ``levels`` has (side, pixels) with pixels (imgid, y, x, v, dy, dx); imgid counts from 0 to ``images``. linid runs
    through images, rows and columns, then on into the next level. Centres and sizes are in the finest level's pixels.
    A node's parent is the coarser level's pixel over it; the coarsest level's nodes are their own.
    """
    ordered = sorted(levels, key=lambda level: level[0])
    base = ordered[-1][0]
    out, offset = None, 0
    for n, (side, pixels) in enumerate(ordered):
        here = F.lit(offset) + F.col("imgid") * side * side + F.col("y") * side + F.col("x")
        if n:
            above, before = ordered[n - 1][0], offset - images * ordered[n - 1][0] ** 2
            parent = F.lit(before) + F.col("imgid") * above * above + F.floor(F.col("y") * above / side) * above + F.floor(F.col("x") * above / side)
        else:
            parent = here
        length = F.sqrt(F.col("dy") ** 2 + F.col("dx") ** 2)
        scale = base / side
        level = pixels.where(F.col("v") > 0).select(
            "imgid", F.lit(side).alias("level"), here.cast("long").alias("linid"), parent.cast("long").alias("parent_linid"),
            ((F.col("y") + 0.5) * scale).alias("cy"), ((F.col("x") + 0.5) * scale).alias("cx"),
            F.when(length > 0, F.col("dy") / length).alias("ny"), F.when(length > 0, F.col("dx") / length).alias("nx"), F.lit(scale).alias("size"),
        )
        out = level if out is None else out.unionByName(level)
        offset += images * side * side
    return out


def with_parents(table: DataFrame) -> DataFrame:
    """Each node with its parent's centre, and the vector from its own to it."""
    parent = table.select(F.col("linid").alias("parent_linid"), F.col("cy").alias("p_cy"), F.col("cx").alias("p_cx"))
    return table.join(parent, "parent_linid", "left").withColumn("to_y", F.col("p_cy") - F.col("cy")).withColumn("to_x", F.col("p_cx") - F.col("cx"))


def chords(table: DataFrame) -> DataFrame:
    """Each node's chord: half its size to either side of the centre, across its normal."""
    y, x = quarter_turn(F.col("ny"), F.col("nx"))
    half = F.col("size") / 2
    return table.select(
        "imgid", "linid", (F.col("cy") + y * half).alias("lf_y"), (F.col("cx") + x * half).alias("lf_x"),
        (F.col("cy") - y * half).alias("rt_y"), (F.col("cx") - x * half).alias("rt_x"), F.col("ny").alias("n_y"), F.col("nx").alias("n_x"),
    )
