"""Synthetic rasters: pure predicates over an S by S grid, with dy and dx from the centre S div 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOP_BAR = "dx > -5 AND dx < 5 AND dy > -10 AND dy < -8"
_TOP_BOX = f"({_TOP_BAR}) OR (dx > -5 AND dx < 5 AND dy > -2 AND dy < 0) OR (dx > -6 AND dx < -4 AND dy > -10 AND dy < 0) OR (dx > 4 AND dx < 6 AND dy > -10 AND dy < 0)"
_RADIUS = "sqrt(dy * dy + dx * dx)"

# Which pixels each shape has. SQL that Spark and DuckDB read alike; S is the side.
SHAPES = {
    "one_square": "y > 3 * side // 8 - 1 AND y <= 5 * side // 8 - 1 AND x > 3 * side // 8 - 1 AND x <= 5 * side // 8 - 1",
    "one_curve": f"dy < 0 AND {_RADIUS} > 11 AND {_RADIUS} < 13",
    "circle": f"{_RADIUS} > 8 AND {_RADIUS} < 10",
    "arc": "sqrt((dy - 4) * (dy - 4) + dx * dx) > 3 AND sqrt((dy - 4) * (dy - 4) + dx * dx) < 7 AND atan2(dy - 4, dx) - pi() / 8 > -pi() / 2 AND atan2(dy - 4, dx) - pi() / 8 < pi() / 2",
    "topbar": _TOP_BAR,
    "vbar": "dx > -2 AND dx < 2 AND dy > -8 AND dy < 8",
    "blob": "dx > -2 AND dx < 2 AND dy > -8 AND dy < -4",
    "rtang": f"({_TOP_BAR}) OR (dx > 5 AND dx < 7 AND dy > -10 AND dy < 0)",
    "topbox": _TOP_BOX,
    "topbox_plus": f"{_TOP_BOX} OR (dx > -6 AND dx < -4 AND dy > -1 AND dy < 6)",
    "nine": f"{_TOP_BOX} OR (dx > 4 AND dx < 6 AND dy > -1 AND dy < 6)",
    "tetris": "(dx > 4 AND dx < 6 AND dy > -4 AND dy < 2) OR (dx > 2 AND dx < 6 AND dy > -2 AND dy < 0)",
    "circle_seed": "(abs(dx) < 4 AND dy > -10 AND dy < -8) OR (abs(dx) < 4 AND dy > 8 AND dy < 10) OR (dx > -10 AND dx < -8 AND abs(dy) < 4) OR (dx > 8 AND dx < 10 AND abs(dy) < 4)",
}
#: These have three channels of values -1 and 1; the others one channel of 0 and 1.
SIGNED = ("one_square", "one_curve")


def grid(spark: SparkSession, side: int = 32) -> DataFrame:
    """(y, x, dy, dx) of every pixel, from one range."""
    cells = spark.range(side * side).select(F.expr(f"id div {side}").alias("y"), (F.col("id") % side).alias("x"))
    return cells.select("y", "x", (F.col("y") - side // 2).alias("dy"), (F.col("x") - side // 2).alias("dx"))


def shape(spark: SparkSession, name: str, side: int = 32) -> DataFrame:
    """(y, x, ch, v) of one shape."""
    inside = F.expr(SHAPES[name].replace("side // 8", "side div 8").replace("side", str(side)))
    channels, low = ([0, 1, 2], -1.0) if name in SIGNED else ([0], 0.0)
    pixels = grid(spark, side).select("y", "x", F.when(inside, 1.0).otherwise(low).alias("v"))
    return pixels.select("y", "x", F.explode(F.array(*map(F.lit, channels))).alias("ch"), "v")


def shape_sql(name: str, side: int = 32) -> str:
    """The same for DuckDB."""
    channels, low = ("[0, 1, 2]", -1.0) if name in SIGNED else ("[0]", 0.0)
    return f"""
        WITH g AS (SELECT i // {side} AS y, i % {side} AS x, i // {side} - {side // 2} AS dy, i % {side} - {side // 2} AS dx FROM range({side * side}) t(i))
        SELECT y, x, unnest({channels}) AS ch, CASE WHEN {SHAPES[name].replace("side", str(side))} THEN 1.0 ELSE {low} END::DOUBLE AS v FROM g"""


def shape_points(spark: SparkSession, name: str, side: int = 32) -> DataFrame:
    """The pixels inside a shape as points (imgid, oid, y, x)."""
    return shape(spark, name, side).where("ch = 0 AND v = 1").select(F.lit(0).cast("long").alias("imgid"), (F.col("y") * side + F.col("x")).alias("oid"), "y", "x")


def shape_set(spark: SparkSession, name: str, length: int = 2000, side: int = 32) -> DataFrame:
    """A dataset that repeats one shape: (idx, y, x, ch, v) for ``length`` images."""
    return spark.range(length).select(F.col("id").alias("idx")).join(shape(spark, name, side))


def arc_quarter(spark: SparkSession, side: int = 600, radius: int = 100, cy: int = 400, cx: int = 400, width: float = 1.0, first: float = 90.0, last: float = 180.0) -> DataFrame:
    """(y, x) of a drawn arc between two angles in degrees, y downward; 0 to 360 is a circle."""
    dy, dx = F.col("y") - cy, F.col("x") - cx
    angle = F.pmod(F.degrees(F.atan2(dy, dx)) + 360, F.lit(360.0))
    near = F.abs(F.sqrt(dy * dy + dx * dx) - radius) <= width / 2
    return grid(spark, side).where(near & (angle >= first) & (angle <= last)).select("y", "x")


def rotated(pixels: DataFrame, degrees: float, side: int = 600) -> DataFrame:
    """(y, x) pixels turned about the centre, each target pixel read from the nearest source pixel."""
    spark = pixels.sparkSession
    c = (side - 1) / 2
    a = F.radians(F.lit(degrees))
    ty, tx = F.col("y") - c, F.col("x") - c
    source = grid(spark, side).select("y", "x", F.rint(F.cos(a) * ty + F.sin(a) * tx + c).cast("long").alias("sy"), F.rint(F.cos(a) * tx - F.sin(a) * ty + c).cast("long").alias("sx"))
    return source.join(pixels.select(F.col("y").alias("sy"), F.col("x").alias("sx")), ["sy", "sx"]).select("y", "x")
