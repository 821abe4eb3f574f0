"""Strings: chords between two ends with a normal and a deviation. Building, meeting, merging, scoring, sampling.

A string is a row (imgid, sid, lf_y, lf_x, rt_y, rt_x, n_y, n_x, dev). Merging joins the ends of strings within a
radius; two variants differ in what they leave out and how the deviation is scaled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chordgrid.functions.geometry import distance, midpoint, quarter_turn, safe_divide, turned_area, unit
from chordgrid.operators import string_passes
from chordgrid.operators.neighbours import mark, neighbours
from chordgrid.operators.storage import stored
from chordgrid.sources.loader import numbered

STRING = ("lf_y", "lf_x", "rt_y", "rt_x", "n_y", "n_x", "dev")


def initial_strings(points: DataFrame, edges: DataFrame) -> DataFrame:
    """One string for each edge of points (imgid, oid, y, x, n_y, n_x): its ends, the mean of their normals, no deviation.

    sid counts nothing: it is made of the ends' oids, and so is the same at each run.
    """
    end = points.select("oid", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), "n_y", "n_x")
    lf = end.select(*[F.col(c).alias(f"l_{c}") for c in end.columns])
    rt = end.select(*[F.col(c).alias(f"r_{c}") for c in end.columns])
    joined = edges.join(lf, F.col("lf") == F.col("l_oid")).join(rt, F.col("rt") == F.col("r_oid"))
    return joined.select(
        "imgid", F.concat_ws("-", "lf", "rt").alias("sid"), F.col("l_y").alias("lf_y"), F.col("l_x").alias("lf_x"), F.col("r_y").alias("rt_y"), F.col("r_x").alias("rt_x"),
        midpoint(F.col("l_n_y"), F.col("r_n_y")).alias("n_y"), midpoint(F.col("l_n_x"), F.col("r_n_x")).alias("n_x"), F.lit(0.0).alias("dev"),
    )


def string_ends(strings: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Both ends of each string as points; side 0 is the left. oid orders ends by string, then side; it is a number where sid is."""
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"{e}_y").alias("y"), F.col(f"{e}_x").alias("x")) for i, e in enumerate(("lf", "rt"))])
    ends = strings.select("*", F.explode(sides).alias("end"))
    oid = F.col("sid") * 2 + F.col("end.side") if dict(strings.dtypes)["sid"] == "bigint" else F.concat_ws("/", "sid", "end.side")
    return ends.select("imgid", "sid", oid.alias("oid"), "end.side", "end.y", "end.x", *STRING, *carry)


def meetings(strings: DataFrame, radius: float, *, inclusive: bool = True, tree: bool = False) -> DataFrame:
    """Pairs of ends within ``radius``: a_ and b_ columns of both strings and the sides that are close; a's end comes first.

    Ends of one string are among them where the string is short enough. With ``tree``, strings have a ``family`` and its
    ``mark``, and pairs whose families meet are left out.
    """
    carry = ("family", "mark") if tree else ()
    ends = string_ends(strings, carry)
    keep = ("sid", "side", *STRING, *carry)
    pairs = neighbours(ends, radius, inclusive=inclusive, keep=keep, tree=tree)
    names = [F.col(f"{c}_{e}").alias(f"{p}_{c}") for c in keep for p, e in (("a", "lf"), ("b", "rt"))]
    return pairs.select("imgid", *names)


def _end(string: str, side: Column, axis: str) -> Column:
    return F.when(side == 0, F.col(f"{string}_lf_{axis}")).otherwise(F.col(f"{string}_rt_{axis}"))


def merged(pairs: DataFrame, *, variant: str = "sf", corrected: bool = False, coincident: float | None = None) -> DataFrame:
    """Candidate strings from pairs of meeting ends, with the two strings they come from.

    The new string spans the far ends. As given, the far end of one string is that on the other's close side; with
    ``corrected`` it is the side opposite to its own close one. Pairs whose far ends all but coincide go. The deviation
    is the middle of the close ends' distance from the chord (variant "sf"), or that by the chord's length ("tree").
    The normal is the chord's, on the side where the strings' mean normal lies ("sf"), or that mean itself ("tree").
    """
    if coincident is None:
        coincident = 0.1 if variant == "sf" else 1e-3
    a, b = F.col("a_side"), F.col("b_side")
    far_a, far_b = (1 - a, 1 - b) if corrected else (b, a)
    out = pairs.select(
        "*", *[_end("a", far_a, c).alias(f"lf_{c}") for c in "yx"], *[_end("b", far_b, c).alias(f"rt_{c}") for c in "yx"],
        *[midpoint(_end("a", a, c), _end("b", b, c)).alias(f"t_{c}") for c in "yx"],
    )
    out = out.withColumn("length", distance(F.col("lf_y"), F.col("lf_x"), F.col("rt_y"), F.col("rt_x"))).where(F.col("length") > coincident)
    area = turned_area(*[F.col(c) for c in ("lf_y", "lf_x", "rt_y", "rt_x", "t_y", "t_x")])
    scale = F.col("length") if variant == "sf" else F.col("length") * F.col("length")
    old_y, old_x = unit(midpoint(F.col("a_n_y"), F.col("b_n_y")), midpoint(F.col("a_n_x"), F.col("b_n_x")))
    if variant == "tree":
        return out.select("*", (area / scale).alias("dev"), old_y.alias("n_y"), old_x.alias("n_x"))
    new_y, new_x = unit(*quarter_turn(F.col("rt_y") - F.col("lf_y"), F.col("rt_x") - F.col("lf_x")))
    # without a mean normal the comparison isn't true, and the normal is turned
    keep = F.when(distance(old_y, old_x, new_y, new_x) < math.sqrt(2), 1.0).otherwise(-1.0)
    return out.select("*", (area / scale).alias("dev"), (keep * new_y).alias("n_y"), (keep * new_x).alias("n_x"))


def similarity() -> Column:
    """How unlike the two strings of a pair are: ratios of deviations and lengths, and distance of normals; null for a zero divisor."""
    lengths = {s: distance(*[F.col(f"{s}_{c}") for c in ("lf_y", "lf_x", "rt_y", "rt_x")]) for s in "ab"}
    normals = distance(F.col("a_n_y"), F.col("a_n_x"), F.col("b_n_y"), F.col("b_n_x"))
    return safe_divide(F.col("a_dev"), F.col("b_dev") + 1e-3) + safe_divide(lengths["a"], lengths["b"] + 1e-3) + normals


def spline_samples(strings: DataFrame, n: int = 10) -> DataFrame:
    """(imgid, sid, k, y, x): ``n`` samples of the parabola through a string's ends whose top lies ``dev`` lengths off the chord.

    It starts at the end that lies first along the chord's direction, which is the normal turned by a quarter.
    """
    ends = strings.withColumn("length", distance(F.col("lf_y"), F.col("lf_x"), F.col("rt_y"), F.col("rt_x")))
    along = {e: -F.col("n_x") * F.col(f"{e}_y") + F.col("n_y") * F.col(f"{e}_x") for e in ("lf", "rt")}
    left = along["lf"] <= along["rt"]
    start = {c: F.when(left, F.col(f"lf_{c}")).otherwise(F.col(f"rt_{c}")) for c in "yx"}
    t = F.col("k") / float(n - 1)
    bend = 4 * F.col("length") * F.col("dev") * t * (1 - t)
    sampled = ends.withColumns({"s_y": start["y"], "s_x": start["x"]}).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    return sampled.select(
        "imgid", "sid", "k", (F.col("s_y") - t * F.col("length") * F.col("n_x") + bend * F.col("n_y")).alias("y"),
        (F.col("s_x") + t * F.col("length") * F.col("n_y") + bend * F.col("n_x")).alias("x"),
    )


def _named(candidates: DataFrame) -> DataFrame:
    """The candidates as strings, named by what they were made of."""
    sid = F.md5(F.concat_ws("|", "a_sid", "a_side", "b_sid", "b_side"))
    return candidates.select("imgid", sid.alias("sid"), *STRING)


def merge_rounds(strings: DataFrame, radii: tuple[float, ...] = (1.0, 2.0), *, limits: string_passes.Limits = string_passes.Limits(), inclusive: bool = True, corrected: bool = False, coincident: float = 0.1) -> DataFrame:
    """Rounds of merging that keep the candidates whose similarity score exceeds 1, in place of the strings before.

    Images within ``limits`` go through all rounds in one pass, blocks of them in a task, larger ones by joins.
    """
    if not radii:
        return strings
    strings = stored(strings, "strings")
    how = string_passes.Merging(tuple(radii), coincident, inclusive, corrected)
    own, _, apart = string_passes.dealt(strings, string_passes.Scored, how, limits)
    values = ", ".join(f"{c} double" for c in STRING)
    found = own.mapInArrow(string_passes.scored_rounds(how, limits), f"imgid {dict(strings.dtypes)['imgid']}, made string, {values}")
    found = found.select("imgid", F.md5("made").alias("sid"), *STRING)
    if apart is None:
        return found
    for radius in radii:
        new = merged(meetings(apart, radius, inclusive=inclusive), variant="sf", corrected=corrected, coincident=coincident).withColumn("score", similarity())
        apart = stored(_named(new.where((F.col("score") > 1) & ~F.isnan("score"))), "strings")
    return found.unionByName(apart)


def string_tree(strings: DataFrame) -> DataFrame:
    """The roots of a tree: strings (imgid, sid, round, a_sid, b_sid, family, mark, ...) numbered in the order of image and name, from round 0."""
    rooted = numbered(strings, "imgid", "sid").withColumn("sid", F.col("idx"))
    none = F.lit(None).cast("long")
    return rooted.select("imgid", "sid", F.lit(0).alias("round"), none.alias("a_sid"), none.alias("b_sid"), *STRING, F.array("sid").alias("family"), mark(F.col("sid")).alias("mark"))


def grown(tree: DataFrame, radius: float, *, inclusive: bool = True, **options) -> DataFrame:
    """A tree with the strings that merge from its own within ``radius``, as its next round; their numbers go on from the last."""
    new = merged(meetings(tree, radius, inclusive=inclusive, tree=True), variant="tree", **options)
    new = new.withColumn("family", F.array_sort(F.array_union("a_family", "b_family"))).withColumn("mark", F.col("a_mark").bitwiseOR(F.col("b_mark")))
    start = tree.agg((F.max("sid") + 1).alias("sid"), (F.max("round") + 1).alias("round")).first()
    placed = numbered(new.select("imgid", "a_sid", "a_side", "b_sid", "b_side", *STRING, "family", "mark"), "imgid", "a_sid", "a_side", "b_sid", "b_side")
    placed = placed.withColumn("sid", F.col("idx") + (start.sid or 0)).withColumn("round", F.lit(start.round or 1))
    own = F.concat("family", F.array("sid")).alias("family"), F.col("mark").bitwiseOR(mark(F.col("sid"))).alias("mark")
    return tree.unionByName(placed.select("imgid", "sid", "round", "a_sid", "b_sid", *STRING, *own))


def merge_forest(strings: DataFrame, radii: tuple[float, ...] = (0.5, 1.0, 1.5), **options) -> DataFrame:
    """(imgid, sid, round, a_sid, b_sid, ..., ancestors): strings and all that rounds of merging add to them.

    A string has the two that it was made of, and the set of all its ancestors. Pairs of one string, of strings with a
    common ancestor, and of a string and its ancestor are left out: a string and its ancestors are its family, and
    families of a pair don't meet. Sets grow by what a round doubles, and stay with their string.
    """
    tree = string_tree(strings)
    for n, radius in enumerate(radii, 1):
        tree = grown(tree, radius, **options)
        if n < len(radii):
            tree = stored(tree, "string-tree")
    return tree.withColumn("ancestors", F.array_except("family", F.array("sid"))).drop("family", "mark")


def forest_sums(strings: DataFrame, radii: tuple[float, ...] = (0.5, 1.0, 1.5), *, limits: string_passes.Limits = string_passes.Limits(), inclusive: bool = True, corrected: bool = False, coincident: float = 1e-3) -> DataFrame:
    """(imgid, round, n_strings, n_ancestors, bent_left, bent_right, places): what ``merge_forest``'s strings add up to.

    Images within ``limits`` go through all rounds in one pass, blocks of them in a task, and no string of the last round is
    written; of larger ones the strings are written as in ``merge_forest``, and the last round's are summed as they are found.
    """
    strings = stored(strings, "strings")
    how = string_passes.Merging(tuple(radii), coincident, inclusive, corrected)
    own, _, apart = string_passes.dealt(strings, string_passes.Trees, how, limits)
    found = own.mapInArrow(string_passes.forest_sums(how, limits), f"imgid {dict(strings.dtypes)['imgid']}, {string_passes.SUMS}")
    sums = [F.sum(c).alias(c) for c in ("n_strings", "n_ancestors", "bent_left", "bent_right", "places")]
    found = found.groupBy("imgid", "round").agg(*sums)
    if apart is None:
        return found
    places = F.col("lf_y") + 2 * F.col("lf_x") + 3 * F.col("rt_y") + 5 * F.col("rt_x")
    joined = merge_forest(apart, radii, inclusive=inclusive, corrected=corrected, coincident=coincident).groupBy("imgid", "round").agg(
        F.count("*").alias("n_strings"), F.sum(F.size("ancestors")).alias("n_ancestors"), F.count_if(F.col("dev") > 0).alias("bent_left"),
        F.count_if(F.col("dev") < 0).alias("bent_right"), F.sum(places).alias("places"),
    )
    return found.unionByName(joined)
