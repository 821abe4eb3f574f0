"""Fixed-radius near neighbours within an image, and what follows from their degrees.

A theta join on distance would compare all pairs of an image. Points fall into cells as wide as the radius; each looks
into its own cell and four of the eight around it, so every pair of cells meets once in an equi-join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chordgrid.operators.storage import stored

#: The radius that joins the eight neighbours of a lattice point.
EIGHT = math.sqrt(2) + 0.01
_HALF = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]


def related(a: Column, b: Column, a_mark: Column, b_mark: Column) -> Column:
    """Whether two sets of ids meet; marks without a common bit say at once that they don't."""
    return (a_mark.bitwiseAND(b_mark) != 0) & F.arrays_overlap(a, b)


def mark(number: Column) -> Column:
    """A bit for an id; a set's mark has the bits of its ids."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (number % 64).cast("int"))


def neighbours(points: DataFrame, radius: float, *, inclusive: bool = True, keep: tuple[str, ...] = (), tree: bool = False) -> DataFrame:
    """(imgid, lf, rt, d) for each unordered pair of points (imgid, oid, y, x) within ``radius``; lf is the smaller oid.

    ``keep`` names columns of the points that follow as <name>_lf and <name>_rt. With ``tree``, points also have a
    ``family``, the ids of their string and its ancestors, and its ``mark``; points whose families meet are no pair, and
    that is looked at before their distance.
    """
    names = ("oid", "y", "x", *dict.fromkeys((*keep, *(("family", "mark") if tree else ()))))
    cell = points.select("imgid", *names, F.floor(F.col("y") / radius).alias("cy"), F.floor(F.col("x") / radius).alias("cx"))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _HALF])
    near = cell.select("imgid", *[F.col(n).alias(f"p_{n}") for n in names], "cy", "cx", F.explode(steps).alias("s"))
    near = near.withColumn("same", (F.col("s.a") == 0) & (F.col("s.b") == 0)).withColumn("cy", F.col("cy") + F.col("s.a")).withColumn("cx", F.col("cx") + F.col("s.b"))
    pairs = near.join(cell, ["imgid", "cy", "cx"]).where(~F.col("same") | (F.col("p_oid") < F.col("oid")))
    if tree:
        pairs = pairs.where(~related(F.col("p_family"), F.col("family"), F.col("p_mark"), F.col("mark")))
    dy, dx = F.col("p_y") - F.col("y"), F.col("p_x") - F.col("x")
    squared = dy * dy + dx * dx
    limit = F.lit(float(radius * radius))
    pairs = pairs.where(squared <= limit if inclusive else squared < limit)
    smaller = F.col("p_oid") < F.col("oid")

    def side(name: str, left: bool):
        return F.when(smaller == left, F.col(f"p_{name}")).otherwise(F.col(name))

    extra = [side(n, left).alias(f"{n}_{end}") for n in keep for left, end in ((True, "lf"), (False, "rt"))]
    return pairs.select("imgid", side("oid", True).alias("lf"), side("oid", False).alias("rt"), F.sqrt(squared.cast("double")).alias("d"), *extra)


def dense_neighbours(points: DataFrame, radius: float, *, inclusive: bool = True, most: int = 4096) -> DataFrame:
    """``neighbours`` where many points share a cell: no task compares more than about ``most`` points with as many others.

    Cells of more points, counted first, are dealt into blocks by a hash of oid, so it doesn't matter how close their
    points are. A point meets the blocks of the cells that it looks into one by one, and theirs meet its own block; where
    no crowded cell is near, points go as in ``neighbours``.
    """
    where = ("imgid", "cy", "cx")
    cell = points.select("imgid", "oid", "y", "x", F.floor(F.col("y") / radius).alias("cy"), F.floor(F.col("x") / radius).alias("cx"))
    crowded = cell.groupBy(*where).count().where(F.col("count") > most)
    crowded = stored(crowded.select(*where, F.ceil(F.col("count") / most).cast("int").alias("blocks")), "crowded-cells")
    if crowded.isEmpty():
        return neighbours(points, radius, inclusive=inclusive)
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(_HALF)])
    block = F.pmod(F.xxhash64("oid"), F.col("blocks")).cast("int")
    one = F.coalesce("blocks", F.lit(1))

    def moved(table: DataFrame) -> DataFrame:
        out = table.withColumn("s", F.explode(steps))
        return out.select(*[c for c in table.columns if c not in where], "imgid", (F.col("cy") + F.col("s.a")).alias("cy"), (F.col("cx") + F.col("s.b")).alias("cx"), F.col("s.step").alias("step"))

    # a looking point names the cell it looks into, that cell's block, and itself: step -1, or its step and block if its own cell is crowded
    looking = moved(cell.join(crowded, [*where], "left").withColumn("own", F.coalesce(block, F.lit(0))).withColumn("crowd", F.col("blocks").isNotNull()).drop("blocks"))
    looking = looking.join(crowded, [*where], "left").select(
        *where, F.explode(F.sequence(F.lit(0), one - 1)).alias("block"), F.when(F.col("crowd"), F.col("step")).otherwise(-1).alias("by"), F.when(F.col("crowd"), F.col("own")).otherwise(0).alias("of"),
        F.col("oid").alias("p_oid"), F.col("y").alias("p_y"), F.col("x").alias("p_x"), (F.col("step") == 0).alias("same"),
    )
    # a point that is looked at waits for points of cells that aren't crowded, and for each block of those that are
    lookers = moved(crowded).groupBy(*where).agg(F.collect_list(F.struct("step", "blocks")).alias("lookers"))  # at most one for each step
    sources = F.flatten(F.transform("lookers", lambda l: F.transform(F.sequence(F.lit(0), l["blocks"] - 1), lambda b: F.struct(l["step"].alias("by"), b.alias("of")))))
    alone = F.array(F.struct(F.lit(-1).alias("by"), F.lit(0).alias("of")))
    seen = cell.join(crowded, [*where], "left").withColumn("block", F.coalesce(block, F.lit(0))).drop("blocks").join(lookers, [*where], "left")
    seen = seen.select(*where, "block", F.explode(F.when(F.col("lookers").isNull(), alone).otherwise(F.concat(alone, sources))).alias("s"), "oid", "y", "x")
    seen = seen.select(*where, "block", "s.by", "s.of", "oid", "y", "x")
    pairs = looking.join(seen, [*where, "block", "by", "of"]).where(~F.col("same") | (F.col("p_oid") < F.col("oid")))
    dy, dx = F.col("p_y") - F.col("y"), F.col("p_x") - F.col("x")
    squared, limit = dy * dy + dx * dx, F.lit(float(radius * radius))
    near = pairs.where(squared <= limit if inclusive else squared < limit)
    return near.select("imgid", F.least("p_oid", "oid").alias("lf"), F.greatest("p_oid", "oid").alias("rt"), F.sqrt(squared).alias("d"))


def mirrored(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    columns = [c for c in edges.columns if c not in ("lf", "rt")]
    return edges.select("lf", "rt", *columns).unionByName(edges.select(F.col("rt").alias("lf"), F.col("lf").alias("rt"), *columns))


def rescaled(points: DataFrame, factor: float = 0.05333333) -> DataFrame:
    """Points with coordinates times ``factor``; as given, a lattice of 600 becomes one of 32."""
    return points.withColumns({c: F.col(c) * factor for c in ("y", "x")})


def degrees(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(imgid, oid, degree); isolated points have 0."""
    counted = mirrored(edges.select("imgid", "lf", "rt")).groupBy(F.col("rt").alias("oid")).agg(F.count("*").alias("n"))
    return points.select("imgid", "oid").join(counted, "oid", "left").select("imgid", "oid", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


def endpoints(points: DataFrame, edges: DataFrame) -> DataFrame:
    """The points none of whose neighbours has strictly fewer neighbours; isolated points are among them."""
    by_oid = degrees(points, edges).select("oid", "degree")
    ends = mirrored(edges.select("lf", "rt")).join(by_oid.select(F.col("oid").alias("lf"), F.col("degree").alias("d_lf")), "lf")
    ends = ends.join(by_oid.select(F.col("oid").alias("rt"), F.col("degree").alias("d_rt")), "rt")
    beaten = ends.where("d_rt < d_lf").select(F.col("lf").alias("oid")).distinct()
    return points.join(beaten, "oid", "left_anti")


def drop_coincident(points: DataFrame, radius: float = 1.2, squared_limit: float = 0.9) -> DataFrame:
    """Points without those that are the left end of an edge whose squared distance is under the limit; in a chain all but the last go."""
    close = neighbours(points, radius).where(F.col("d") * F.col("d") < squared_limit).select(F.col("lf").alias("oid")).distinct()
    return points.join(close, "oid", "left_anti")


def bipartite_neighbours(left: DataFrame, right: DataFrame, radius: float, *, inclusive: bool = True) -> DataFrame:
    """(imgid, lf, rt, d) for pairs of a left and a right point within ``radius``."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    cy, cx = F.floor(F.col("y") / radius), F.floor(F.col("x") / radius)
    a = left.select("imgid", F.col("oid").alias("lf"), F.col("y").alias("ly"), F.col("x").alias("lx"), cy.alias("cy"), cx.alias("cx"), F.explode(steps).alias("s"))
    a = a.withColumn("cy", F.col("cy") + F.col("s.a")).withColumn("cx", F.col("cx") + F.col("s.b")).drop("s")
    b = right.select("imgid", F.col("oid").alias("rt"), "y", "x", cy.alias("cy"), cx.alias("cx"))
    pairs = a.join(b, ["imgid", "cy", "cx"])
    squared = (F.col("ly") - F.col("y")) ** 2 + (F.col("lx") - F.col("x")) ** 2
    limit = F.lit(float(radius * radius))
    return pairs.where(squared <= limit if inclusive else squared < limit).select("imgid", "lf", "rt", F.sqrt(squared).alias("d"))
