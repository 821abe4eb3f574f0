"""Raster values off the lattice against plain loops, and what is built on them."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chordgrid.operators import pyramid, views
from chordgrid.operators.gather import gathered
from chordgrid.sources import loader

RNG = np.random.default_rng(8)
IMAGES = RNG.random((3, 6, 6)).round(3)


@pytest.fixture(scope="module")
def raster(spark):
    rows = [(i, y, x, float(IMAGES[i, y, x])) for i in range(3) for y in range(6) for x in range(6)]
    return spark.createDataFrame(rows, "imgid long, y long, x long, v double")


def weights(at, mode):
    if mode == "nearest":
        return [(round(at), 1.0)]
    low = math.floor(at)
    if mode == "bilinear":
        return [(low, 1 - at + low), (low + 1, at - low)]

    def cubic(t):
        t = abs(t)  # slope -1
        return t**3 - 2 * t**2 + 1 if t <= 1 else -(t**3) + 5 * t**2 - 8 * t + 4

    return [(low + k, cubic(at - low - k)) for k in (-1, 0, 1, 2)]


@pytest.mark.parametrize("mode", ["nearest", "bilinear", "bicubic"])
@pytest.mark.parametrize("side", [None, 6])
def test_places_off_the_lattice(spark, raster, mode, side):
    places = [(int(i % 4), i, float(y), float(x)) for i, (y, x) in enumerate([*(RNG.random((80, 2)) * 8 - 1.5), (0.5, 1.5), (2.5, -0.5), (5.5, 0.0), (-0.5, 5.49), (3.0, 4.0)])]
    table = spark.createDataFrame(places, "imgid long, key int, y double, x double")
    got = {r.key: r.v for r in gathered(raster, table, ("key",), mode, side=side, outside=0.25).collect()}
    assert len(got) == len(places)
    for image, key, y, x in places:
        inside = side is None or (-0.5 <= y < side - 0.5 and -0.5 <= x < side - 0.5)
        total = 0.0
        for (ty, wy) in weights(y, mode):
            for (tx, wx) in weights(x, mode):
                if side is not None:
                    ty, tx = min(max(ty, 0), side - 1), min(max(tx, 0), side - 1)
                known = image < 3 and 0 <= ty < 6 and 0 <= tx < 6
                total += wy * wx * (IMAGES[image, ty, tx] if known else 0.25)
        assert abs(got[key] - (total if inside else 0.25)) < 1e-9


def test_turned_images(spark, raster):
    turned = {(r.imgid, r.y, r.x): r.v for r in loader.rotated(raster, 6, F.lit(90.0)).collect()}
    assert all(abs(turned[i, y, x] - np.rot90(IMAGES[i])[y, x]) < 1e-9 for i, y, x in turned) and len(turned) == 108
    whole = loader.rotated(raster, 6, F.lit(0.0))
    assert {(r.imgid, r.y, r.x, round(r.v, 9)) for r in whole.collect()} == {(r.imgid, r.y, r.x, r.v) for r in raster.collect()}
    cut = loader.rotated(raster, 6, F.lit(30.0), limits=(0.3, 0.6))
    assert cut.agg(F.min("v"), F.max("v")).first() == (0.3, 0.6)


def test_limits_of_the_base(raster):
    plain, cut = (pyramid.bilinear_resize(raster, 6, 9, limits) for limits in (None, (0.4, 0.5)))
    expected = {(r.imgid, r.y, r.x): min(max(r.v, 0.4), 0.5) for r in plain.collect()}
    assert {(r.imgid, r.y, r.x): r.v for r in cut.collect()} == expected


def test_arrows_to_parents(spark):
    rows = [(0, 1.0, 2.0), (1, 3.0, 4.0), (2, 5.0, 7.0)]
    chords = spark.createDataFrame([(r, y, x, 1.0, 0.0, y, x, y, x) for r, y, x in rows], "row long, cy double, cx double, n_y double, n_x double, lf_y double, lf_x double, rt_y double, rt_x double")
    parents = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "row long, parent long")
    got = {r.row: r for r in views.string_view(chords, parents).collect()}
    assert {k: (r.to_x, r.to_y) for k, r in got.items()} == {0: (0.0, 0.0), 1: (-50.0, -50.0), 2: (-75.0, -50.0)}
    assert all((got[r].pr, got[r].pg, got[r].pb) == (got[p].r, got[p].g, got[p].b) for r, p in ((0, 0), (1, 0), (2, 1)))
    alone = views.string_view(chords).collect()
    assert all(r.to_x is None and r.pr is None and r.ny == 25.0 for r in alone)


def test_one_loader(spark, raster):
    pictures = spark.createDataFrame([(i, i % 2) for i in range(3)], "imgid long, label int")
    plain = loader.EngineOptions(img_size=6, batch_size=2)
    got = loader.load(pictures, raster, plain).collect()
    assert {(r.batch, r.idx, r.imgid, r.label) for r in got} == {(0, 0, 0, 0), (0, 1, 1, 1)} and all(r.v == IMAGES[r.imgid, r.y, r.x] for r in got) and len(got) == 72
    # the second image again and again, in the sizes that debugging goes through
    only = loader.EngineOptions(img_size=6, batch_size=1, oneim_dataset=True, train_scale=(0.4, 1.0))
    many = spark.range(18).select(F.col("id").alias("imgid"), F.lit(3).alias("label"))
    pixels = many.select("imgid", F.explode(F.sequence(F.lit(0), F.lit(35))).alias("i")).select("imgid", F.expr("i div 6").alias("y"), (F.col("i") % 6).cast("long").alias("x"), F.lit(0.5).alias("v"))
    shown = loader.load(many, pixels, only)
    assert {(r.imgid, r.label) for r in shown.select("imgid", "label").distinct().collect()} == {(17, 0)} and shown.count() == 18 * 36
    lit = {r.idx: r.n for r in shown.where("v = 0.5").groupBy("idx").agg(F.count("*").alias("n")).collect()}
    assert [lit.get(i, 0) for i in range(4)] == [4, 4, 16, 36] and lit[7] == 36
