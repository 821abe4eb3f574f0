from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chordgrid.operators.components import components
from chordgrid.operators.neighbours import EIGHT, bipartite_neighbours, dense_neighbours, endpoints, neighbours
from chordgrid.operators.strings import initial_strings, meetings, merged
from chordgrid.sources.shapes import shape_points

# pixels, edges, components, endpoints
GOLDEN = {
    "one_square": (64, 210, 1, 36), "one_curve": (69, 160, 1, 27), "circle": (108, 256, 1, 40), "arc": (58, 173, 1, 16), "topbar": (9, 8, 1, 7),
    "vbar": (45, 128, 1, 26), "blob": (9, 20, 1, 4), "rtang": (18, 16, 2, 14), "topbox": (36, 40, 1, 28), "topbox_plus": (42, 47, 1, 32),
    "nine": (42, 47, 1, 32), "tetris": (7, 8, 1, 4), "circle_seed": (28, 24, 4, 20),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_counts(spark, name):
    points = shape_points(spark, name).cache()
    edges = neighbours(points, EIGHT).cache()
    groups = components(points, edges).select("ccid").distinct().count()
    assert (points.count(), edges.count(), groups, endpoints(points, edges).count()) == GOLDEN[name]


@pytest.mark.parametrize("name, inclusive, expected", [
    ("topbar", True, (35, 8, 35)), ("topbar", False, (7, 0, 7)), ("blob", True, (360, 12, 312)), ("blob", False, (80, 0, 40)),
    ("topbox", True, (228, 36, 216)), ("tetris", True, (55, 6, 49)), ("tetris", False, (15, 0, 10)),
])
def test_first_merge_round(spark, name, inclusive, expected):
    points = shape_points(spark, name).withColumns({"n_y": F.lit(1.0), "n_x": F.lit(0.0)})
    pairs = meetings(initial_strings(points, neighbours(points, EIGHT)), 1.0, inclusive=inclusive).cache()
    assert (pairs.count(), pairs.where("a_sid = b_sid").count(), merged(pairs).count()) == expected


def test_neighbours_equal_all_pairs(spark):
    rows = [(i % 3, i, (i * 37 % 101) / 7 - 5, (i * 53 % 97) / 9 - 4) for i in range(300)]
    points = spark.createDataFrame(rows, "imgid long, oid long, y double, x double")
    for radius in (0.5, 1.0, 2.3):
        near = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= radius * radius}
        assert {(r.lf, r.rt) for r in neighbours(points, radius).collect()} == near
        left, right = points.where("oid < 100"), points.where("oid >= 100")
        assert {(r.lf, r.rt) for r in bipartite_neighbours(left, right, radius).collect()} == {(a, b) for a, b in near if a < 100 <= b}


def test_crowded_cells_are_dealt_into_blocks(spark):
    # one cell's area holds 3,000 points, all but a few at one place; others are spread out
    rows = [(i % 2, i, 0.5, 0.5) if i < 2500 else (i % 2, i, (i * 37 % 101) / 100, (i * 53 % 97) / 97) if i < 3000 else (i % 2, i, (i * 37 % 501) / 7 - 9, (i * 53 % 497) / 9 - 9) for i in range(3600)]
    points = spark.createDataFrame(rows, "imgid long, oid long, y double, x double")
    plain = neighbours(points, 1.0)
    dealt = dense_neighbours(points, 1.0, most=200)
    total = plain.count()
    assert total > 1_500_000 and dealt.count() == total and dealt.select("lf", "rt").distinct().count() == total
    assert plain.join(dealt, ["imgid", "lf", "rt"], "left_anti").isEmpty() and dealt.where("lf >= rt").isEmpty()
    assert dense_neighbours(points, 1.0, most=200, inclusive=False).count() == neighbours(points, 1.0, inclusive=False).count()
    assert dense_neighbours(points.where("oid >= 3000"), 1.0).count() == neighbours(points.where("oid >= 3000"), 1.0).count()


def test_a_point_outside_finds_all_that_are_near_in_a_crowded_cell(spark):
    points = spark.range(1_000_000).select(F.lit(0).cast("long").alias("imgid"), F.col("id").alias("oid"), (F.col("id") % 1000 / 2000).alias("y"), F.lit(0.25).alias("x"))
    # a point 0.74 away from the middle of the cell looks into it: its neighbours are those within the radius
    looker = spark.createDataFrame([(0, -1, 0.25, -0.2)], "imgid long, oid long, y double, x double")
    met = dense_neighbours(points.where("oid % 1000 = 0 OR oid < 20000").unionByName(looker), 0.5, most=1000).where("lf = -1")
    near = [o for o in range(1_000_000) if (o % 1000 == 0 or o < 20000) and (o % 1000 / 2000 - 0.25) ** 2 + 0.45**2 <= 0.25]
    assert met.count() == len(near)


def test_large_images_have_the_same_components(spark):
    rows = [(i % 3, i, float(i * 37 % 101), float(i * 53 % 97)) for i in range(900) if i % 3 < 2 or i < 90]
    points = spark.createDataFrame(rows, "imgid long, oid long, y double, x double")
    edges = neighbours(points, 4.0)
    small = sorted(components(points, edges, block=100).collect())
    for whole in (100, 1):
        assert sorted(components(points, edges, whole=whole).collect()) == small
    label = {r.oid: r.ccid for r in small}
    assert all(label[r.lf] == label[r.rt] for r in edges.collect()) and all(c <= o for o, c in label.items())
    assert len(set(label.values())) > 3 and components(points.limit(0), edges).count() == 0
