"""Aggregates: pools, statistics, packing of component features, and scattering points to rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _pooled(df: DataFrame, value: str, images: DataFrame, how: Column) -> DataFrame:
    found = df.groupBy("imgid").agg(how.alias("pooled"))
    return images.select("imgid").join(found, "imgid", "left").select("imgid", F.coalesce("pooled", F.lit(0.0)).alias(value))


def avg_pool(df: DataFrame, value: str, images: DataFrame) -> DataFrame:
    """Mean of ``value`` for each of ``images``; 0 for an image without rows."""
    return _pooled(df, value, images, F.avg(value))


def sum_pool(df: DataFrame, value: str, images: DataFrame) -> DataFrame:
    """Sum of ``value`` for each of ``images``; 0 for an image without rows."""
    return _pooled(df, value, images, F.sum(F.col(value).cast("double")))


def statistics(df: DataFrame, value: str) -> DataFrame:
    """Least, largest and mean value, as one row."""
    return df.agg(F.min(value).alias("min_v"), F.max(value).alias("max_v"), F.avg(value).alias("mean_v"))


def normalised(df: DataFrame, value: str = "v") -> DataFrame:
    """``value`` scaled so that each image spans 0 to 1; an image of one value becomes 0."""
    image = Window.partitionBy("imgid")
    low, span = F.min(value).over(image), F.max(value).over(image) - F.min(value).over(image)
    return df.withColumn(value, F.when(span > 0, (F.col(value) - low) / span).otherwise(0.0))


def denormalised(df: DataFrame, value: str = "v") -> DataFrame:
    """Images with a value under -1e-4 go from -1..1 to 0..1; others stay."""
    low = F.min(value).over(Window.partitionBy("imgid"))
    return df.withColumn(value, F.when(low < -1e-4, (F.col(value) + 1) / 2).otherwise(F.col(value)))


def regrid(points: DataFrame, value: str, side: int, *, average: bool = True, base: DataFrame | None = None) -> DataFrame:
    """(imgid, y, x, value): points (imgid, y, x) added up at their nearest pixels, all pixels of their images listed.

    The average divides by one more than the count, as the initial raster counts once; ``base`` (imgid, y, x, value)
    is that raster, 0 where absent.
    """
    place = {c: F.least(F.greatest(F.rint(c), F.lit(0)), F.lit(side - 1)).cast("long") for c in ("y", "x")}
    hits = points.select("imgid", place["y"].alias("y"), place["x"].alias("x"), value).groupBy("imgid", "y", "x").agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    cells = points.select("imgid").distinct().select("imgid", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("i"))
    cells = cells.select("imgid", F.expr(f"cast(i div {side} as long)").alias("y"), (F.col("i") % side).cast("long").alias("x"))
    out = cells.join(hits, ["imgid", "y", "x"], "left")
    start = F.lit(0.0)
    if base is not None:
        out = out.join(base.withColumnRenamed(value, "start"), ["imgid", "y", "x"], "left")
        start = F.coalesce("start", F.lit(0.0))
    total = start + F.coalesce("s", F.lit(0.0))
    return out.select("imgid", "y", "x", (total / (F.coalesce("n", F.lit(0)) + 1) if average else total).alias(value))


def stack_bind(items: DataFrame, features: list[str], width: int = 350) -> DataFrame:
    """(imgid, ccid, packed): a component's feature rows end to end in order of oid, cut or filled with 0 to ``width``.

    Only the first rows that fit are gathered, so a huge component costs no more than a small one.
    """
    rows = -(-width // len(features))
    rank = F.row_number().over(Window.partitionBy("imgid", "ccid").orderBy("oid"))
    first = items.withColumn("rank", rank).where(F.col("rank") <= rows)
    feature = F.array(*[F.col(f).cast("double") for f in features])
    listed = first.groupBy("imgid", "ccid").agg(F.sort_array(F.collect_list(F.struct("rank", feature.alias("f")))).alias("rows"))
    flat = F.flatten(F.transform("rows", lambda r: r["f"]))
    filled = F.concat(flat, F.array_repeat(F.lit(0.0), width))
    return listed.select("imgid", "ccid", F.slice(filled, 1, width).alias("packed"))


def mean_neighbour_distance(edges: DataFrame) -> DataFrame:
    """(oid, mean_d) over the edges at each point."""
    ends = edges.select(F.col("lf").alias("oid"), "d").unionByName(edges.select(F.col("rt").alias("oid"), "d"))
    return ends.groupBy("oid").agg(F.avg("d").alias("mean_d"))
