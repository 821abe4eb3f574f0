"""Draw-ready tables: what a drawing needs, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chordgrid.functions.geometry import midpoint, palette


def scaled(table: DataFrame, columns: tuple[str, ...], scale: float = 25.0, shift: float = 0.5) -> DataFrame:
    """Coordinates in the drawing's pixels; the table itself stays as it is."""
    return table.withColumns({c: (F.col(c) + shift) * scale for c in columns})


def edge_segments(points: DataFrame, edges: DataFrame, image: int | None = None, *, by: str = "source") -> DataFrame:
    """(lf, rt, x0, y0, x1, y1, r, g, b): edges as coloured segments, of all images or one; an edge belongs by its source, or by either end."""
    at = points.select("oid", "imgid", F.col("y"), F.col("x"))
    lf = at.select(*[F.col(c).alias(f"l_{c}") for c in at.columns])
    rt = at.select(*[F.col(c).alias(f"r_{c}") for c in at.columns])
    joined = edges.select("lf", "rt").join(lf, F.col("lf") == F.col("l_oid")).join(rt, F.col("rt") == F.col("r_oid"))
    if image is not None:
        mine = F.col("l_imgid") == image
        joined = joined.where(mine if by == "source" else mine | (F.col("r_imgid") == image))
    joined = scaled(joined, ("l_y", "l_x", "r_y", "r_x"))
    colours = [c.alias(name) for c, name in zip(palette(F.col("rt")), "rgb")]
    return joined.select("lf", "rt", F.col("l_x").alias("x0"), F.col("l_y").alias("y0"), F.col("r_x").alias("x1"), F.col("r_y").alias("y1"), *colours)


def edge_vectors(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(lf, rt, x, y, dx, dy): arrows from source to destination."""
    at = points.select("oid", "y", "x")
    lf = at.select(F.col("oid").alias("lf"), F.col("y").alias("ly"), F.col("x").alias("lx"))
    rt = at.select(F.col("oid").alias("rt"), F.col("y").alias("ry"), F.col("x").alias("rx"))
    joined = edges.select("lf", "rt").join(lf, "lf").join(rt, "rt")
    return joined.select("lf", "rt", F.col("lx").alias("x"), F.col("ly").alias("y"), (F.col("rx") - F.col("lx")).alias("dx"), (F.col("ry") - F.col("ly")).alias("dy"))


def keypoints(points: DataFrame, scale: float = 25.0) -> DataFrame:
    """(oid, x, y, degrees, size); points without angle or size get 0 and one scale."""
    angle = F.degrees("angle") if "angle" in points.columns else F.lit(0.0)
    size = F.col("size") * scale if "size" in points.columns else F.lit(scale)
    return points.select("oid", F.col("x"), F.col("y"), angle.alias("degrees"), size.alias("size"))


def group_colours(points: DataFrame, group: str) -> DataFrame:
    """(oid, x, y, r, g, b): points in their group's colour."""
    return points.select("oid", "x", "y", *[c.alias(name) for c, name in zip(palette(F.col(group)), "rgb")])


def string_segments(strings: DataFrame, scale: float = 25.0, shift: float = 0.0) -> DataFrame:
    """(sid, x0, y0, x1, y1, mx, my, nx, ny): chords with their middle and normal."""
    at = scaled(strings, ("lf_y", "lf_x", "rt_y", "rt_x"), scale, shift)
    return at.select(
        "sid", F.col("lf_x").alias("x0"), F.col("lf_y").alias("y0"), F.col("rt_x").alias("x1"), F.col("rt_y").alias("y1"),
        midpoint(F.col("lf_x"), F.col("rt_x")).alias("mx"), midpoint(F.col("lf_y"), F.col("rt_y")).alias("my"), F.col("n_x").alias("nx"), F.col("n_y").alias("ny"),
    )


def string_view(chords: DataFrame, parents: DataFrame | None = None, scale: float = 25.0) -> DataFrame:
    """(row, x, y, nx, ny, x0, y0, x1, y1, to_x, to_y, r, g, b, pr, pg, pb): strings as a drawing shows them.

    ``chords`` has (row, cy, cx, n_y, n_x, lf_y, ..., rt_x), rows counted from 0. Centres, normals and ends are scaled,
    colours go by the row. With ``parents`` (row, parent), rows of the same table, an arrow goes to the parent's centre in
    the parent's colour; without, these columns are null.
    """
    colours = lambda row, names: [c.alias(n) for c, n in zip(palette(row * 20), names)]
    fields = {"x": "cx", "y": "cy", "nx": "n_x", "ny": "n_y", "x0": "lf_x", "y0": "lf_y", "x1": "rt_x", "y1": "rt_y"}
    own = chords.select("row", *[(F.col(c) * scale).alias(name) for name, c in fields.items()])
    none = F.lit(None).cast("double")
    if parents is None:
        return own.select("*", none.alias("to_x"), none.alias("to_y"), *colours(F.col("row"), "rgb"), *[none.alias(n) for n in ("pr", "pg", "pb")])
    above = own.select(F.col("row").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"))
    met = own.join(parents.select("row", "parent"), "row", "left").join(above, "parent", "left")
    arrow = [(F.col("px") - F.col("x")).alias("to_x"), (F.col("py") - F.col("y")).alias("to_y")]
    return met.select("row", *fields, *arrow, *colours(F.col("row"), "rgb"), *colours(F.col("parent"), ("pr", "pg", "pb")))
