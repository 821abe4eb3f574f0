"""Canny edges of one-channel pixel tables (imgid, oid, y, x, v), after the published method.

Gradients are sums over the nine pixels around, so an image needs no single task; pixels outside are 0. Thinning keeps
a pixel not less than its neighbour in the gradient's direction and more than the one against it. Weak pixels stay where
they connect to a strong one through weak ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chordgrid.operators.components import components
from chordgrid.operators.neighbours import EIGHT, neighbours

# Tangents of 22.5 and 67.5 degrees, between which a gradient is diagonal.
_LOW, _HIGH = 0.41421356, 2.41421356


def grey(pixels: DataFrame) -> DataFrame:
    """(imgid, y, x, v): the mean of the channels."""
    return pixels.groupBy("imgid", "y", "x").agg(F.avg("v").alias("v"))


def sobel(pixels: DataFrame) -> DataFrame:
    """(imgid, oid, y, x, v, dy, dx) by the 3 by 3 Sobel masks, as one aggregation of each pixel's nine shares."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    given = pixels.select("imgid", "y", "x", "v", F.explode(steps).alias("s"))
    a, b = F.col("s.a"), F.col("s.b")
    # a pixel gives its value to the pixel it is offset from
    given = given.select("imgid", (F.col("y") - a).alias("y"), (F.col("x") - b).alias("x"), (a * (2 - F.abs(b)) * F.col("v")).alias("gy"), (b * (2 - F.abs(a)) * F.col("v")).alias("gx"))
    sums = given.groupBy("imgid", "y", "x").agg(F.sum("gy").alias("dy"), F.sum("gx").alias("dx"))
    return pixels.join(sums, ["imgid", "y", "x"])


def thinned(gradients: DataFrame) -> DataFrame:
    """(imgid, oid, y, x, dy, dx, m) of the pixels that are the greatest across their edge."""
    at = gradients.select("imgid", "oid", "y", "x", F.round("dy", 6).alias("dy"), F.round("dx", 6).alias("dx"), F.round(F.sqrt(F.col("dy") ** 2 + F.col("dx") ** 2), 6).alias("m"))
    flat = F.abs("dy") <= _LOW * F.abs("dx")
    steep = F.abs("dy") >= _HIGH * F.abs("dx")
    stepped = at.withColumn("sy", F.when(flat, 0).otherwise(1))
    stepped = stepped.withColumn("sx", F.when(flat, 1).when(steep, 0).otherwise((F.signum("dy") * F.signum("dx")).cast("int")))
    other = at.select("imgid", "y", "x", "m")
    ahead = other.select("imgid", F.col("y").alias("ay"), F.col("x").alias("ax"), F.col("m").alias("am"))
    behind = other.select("imgid", F.col("y").alias("by"), F.col("x").alias("bx"), F.col("m").alias("bm"))
    both = stepped.withColumns({"ay": F.col("y") + F.col("sy"), "ax": F.col("x") + F.col("sx"), "by": F.col("y") - F.col("sy"), "bx": F.col("x") - F.col("sx")})
    both = both.join(ahead, ["imgid", "ay", "ax"], "left").join(behind, ["imgid", "by", "bx"], "left")
    keep = (F.col("m") > 0) & (F.col("m") >= F.coalesce("am", F.lit(0.0))) & (F.col("m") > F.coalesce("bm", F.lit(0.0)))
    return both.where(keep).select("imgid", "oid", "y", "x", "dy", "dx", "m")


def canny(pixels: DataFrame, low: float, high: float) -> DataFrame:
    """(imgid, oid, y, x, dy, dx, m): edge pixels with gradient and magnitude ``m``."""
    weak = thinned(sobel(pixels)).where(F.col("m") > low)
    joined = components(weak, neighbours(weak, EIGHT))
    strong = joined.where(F.col("m") > high).select("ccid").distinct()
    return joined.join(strong, "ccid", "left_semi").select("imgid", "oid", "y", "x", "dy", "dx", "m")
