from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chordgrid.operators import segnet, strings, unionfind
from chordgrid.operators.components import roots
from chordgrid.operators.neighbours import EIGHT, endpoints, neighbours
from chordgrid.operators.unionfind import UnionFind
from chordgrid.sources import images, loader
from chordgrid.sources.shapes import arc_quarter, rotated, shape, shape_points
from chordgrid.streaming.metrics import METRICS, running_means, totals


def test_components_of_a_long_chain_and_nothing(spark):
    chain = spark.range(500).select(F.col("id").alias("lf"), (F.col("id") + 1).alias("rt"))
    found = roots(chain).collect()
    assert len(found) == 500 and {r.root for r in found} == {0}
    assert roots(chain.where("lf < 0")).count() == 0


def test_union_find(spark):
    forest = UnionFind.of(spark, [5, 7, 9, 5])
    assert (forest.n_elts, forest.n_comps, forest.at(1)) == (3, 3, 7)
    joined = forest.union(spark.createDataFrame([(9, 5, 0), (11, 12, 1)], "x long, y long, order long"))
    assert (len(joined), joined.n_comps) == (5, 3)
    assert joined.find(9) == joined.find(5) == 2
    assert {r.x for r in joined.component(11).collect()} == {11, 12}
    assert {tuple(r.members) for r in joined.components().collect()} == {(5, 9), (7,), (11, 12)}
    asked = spark.createDataFrame([(5, 9), (5, 7), (5, 99)], "x long, y long")
    assert {(r.y, r.connected) for r in joined.connected(asked).collect()} == {(9, True), (7, False), (99, None)}
    assert joined.relabel(0, 50).find(50) == 2
    with pytest.raises(ValueError):
        joined.find(99)
    with pytest.raises(IndexError):
        joined.at(-1)
    assert repr(joined) == "UnionFind(n_elts=5, n_comps=3)"


class Plain:
    """The rule of roots one link at a time."""

    def __init__(self):
        self.index, self.parent, self.size = {}, [], []

    def add(self, x):
        if x not in self.index:
            self.index[x] = len(self.parent)
            self.parent.append(self.index[x])
            self.size.append(1)

    def find(self, x):
        i = self.index[x]
        while self.parent[i] != i:
            i = self.parent[i]
        return i

    def union(self, x, y):
        self.add(x)
        self.add(y)
        a, b = self.find(x), self.find(y)
        if a != b:
            low, high = (a, b) if self.size[a] < self.size[b] else (b, a)
            self.parent[low] = high
            self.size[high] += self.size[low]


@pytest.mark.parametrize("replay", [1_000_000, 3])
def test_roots_follow_the_order_of_links_over_batches(spark, monkeypatch, replay):
    monkeypatch.setattr(unionfind, "VERSIONS", 3)
    rng = np.random.default_rng(6)
    forest, plain = UnionFind.of(spark, [3, 1], replay=replay), Plain()
    plain.add(3)
    plain.add(1)
    for batch in range(4):
        links = [(int(a), int(b), i) for i, (a, b) in enumerate(rng.integers(0, 60, (12, 2)))]
        forest = forest.union(spark.createDataFrame(links, "x long, y long, order long").repartition(3))
        fresh = {}
        for x, y, _ in links:
            fresh |= {x: None, y: None}
        for x in fresh:
            plain.add(x)
        for x, y, _ in links:
            plain.union(x, y)
        assert {(r.x, r.idx, r.root) for r in forest.labelled().collect()} == {(x, i, plain.find(x)) for x, i in plain.index.items()}
    assert len(forest.versions) < 3 and forest.n_comps == len({plain.find(x) for x in plain.index})
    assert forest.union(spark.createDataFrame([(3, 3, 0)], "x long, y long, order long")).versions == forest.versions


def test_spline_meets_ends_and_deviation(spark):
    row = [(0, "a", 0.0, 0.0, 0.0, 4.0, 1.0, 0.0, 0.5)]
    table = spark.createDataFrame(row, "imgid long, sid string, lf_y double, lf_x double, rt_y double, rt_x double, n_y double, n_x double, dev double")
    curve = {r.k: (r.y, r.x) for r in strings.spline_samples(table, 11).collect()}
    assert np.allclose([curve[0], curve[5], curve[10]], [(0, 0), (2, 2), (0, 4)])


def test_network_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 6)).round(4)
    layers = segnet.weights((6, 4, 5), classes=3)
    rows = [(i % 4, [*map(float, v)]) for i, v in enumerate(x)]
    packed = spark.createDataFrame(rows, "imgid long, x array<double>")
    got = {r.imgid: r.x for r in segnet.forward(packed, spark.range(5).withColumnRenamed("id", "imgid"), layers).collect()}
    norm = lambda v: (v - v.mean(0)) / np.sqrt(v.var(0) + 1e-5)
    for w in layers[:-1]:
        x = np.maximum(norm(x @ w.T), 0)
    pooled = np.array([x[np.arange(20) % 4 == i].mean(0) if i < 4 else np.zeros(5) for i in range(5)])
    want = np.maximum(norm(pooled) @ layers[-1].T, 0)
    assert np.allclose([got[i] for i in range(5)], want, atol=1e-6)


def test_loader(spark):
    table = loader.numbered(spark.range(1000).withColumnRenamed("id", "imgid"), "imgid")
    assert sorted((r.imgid, r.idx) for r in table.collect()) == [(i, i) for i in range(1000)]
    assert loader.subset(table, 300).count() == 333 and loader.subset(table, None).count() == 1000
    with pytest.raises(ValueError):
        loader.subset(table, 2000)
    assert loader.batches(table, 64).agg(F.max("batch")).first()[0] == 14
    options = loader.EngineOptions(exp_name="a/b.c", save_folder="/x", base_dataset="tiny-imagenet")
    assert options.channels == 3 and options.save_dir == "/x/a_b_c" and any("[default" in line for line in options.listing())
    with pytest.raises(ValueError):
        loader.EngineOptions(train_scale=(1.5, 2.0))
    assert loader.load_images(spark, spark.range(50).withColumnRenamed("id", "imgid"), options, train=False).count() == 48


def test_image_files(spark, tmp_path):
    for name, value in (("b", 10), ("a", 250)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "i.pgm").write_bytes(b"P5\n# c\n3 2\n255\n" + bytes([value] * 6))
    found = images.image_folder(spark, str(tmp_path)).collect()
    assert {(r.label, r.h, r.w, r.c, round(r.data[0] * 255)) for r in found} == {(0, 2, 3, 1, 250), (1, 2, 3, 1, 10)}
    assert [tuple(r) for r in images.class_list(spark, str(tmp_path)).orderBy("label").collect()] == [(0, "a"), (1, "b")]
    cells = images.pixels(images.image_folder(spark, str(tmp_path)))
    assert cells.count() == 12 and cells.agg(F.max("y"), F.max("x")).first() == (1, 2)
    cifar = tmp_path / "data_batch_2.bin"
    cifar.write_bytes(bytes([7]) + bytes(3072) + bytes([9]) + bytes([255] * 3072))
    assert {(r.imgid, r.label, len(r.data)) for r in images.cifar10(spark, str(cifar)).collect()} == {(20000, 7, 3072), (20001, 9, 3072)}
    (tmp_path / "im").write_bytes(b"\0\0\x08\x03" + b"".join(n.to_bytes(4, "big") for n in (2, 2, 2)) + bytes(range(8)))
    (tmp_path / "lb").write_bytes(b"\0\0\x08\x01" + (2).to_bytes(4, "big") + bytes([3, 4]))
    assert [r.label for r in images.mnist(spark, str(tmp_path / "im"), str(tmp_path / "lb")).orderBy("imgid").collect()] == [3, 4]


def test_drawn_arcs(spark):
    circle = arc_quarter(spark, 60, 20, 30, 30, 2.0, 0.0, 360.0)
    quarter = arc_quarter(spark, 60, 20, 30, 30, 2.0)
    assert 0 < quarter.count() < circle.count()
    assert rotated(circle, 0.0, 60).count() == circle.count()
    assert shape(spark, "one_square", 64).where("ch = 0 and v = 1").count() == 256


def test_checkpoint(spark, tmp_path):
    weights = spark.createDataFrame([("a", [1.0]), ("sampler.x", [2.0]), ("my_canny", [3.0])], "name string, values array<double>")
    saved = spark.read.parquet(loader.save_checkpoint(weights, str(tmp_path), 1, 2))
    assert [r.name for r in saved.collect()] == ["a"]
    current = spark.createDataFrame([("a", [9.0]), ("b", [8.0])], "name string, values array<double>")
    assert {(r.name, r["values"][0]) for r in loader.load_checkpoint(current, saved).collect()} == {("a", 1.0), ("b", 8.0)}


def test_running_means(spark, tmp_path):
    rows = [(i, float(i), 1.0, 2.0, 3.0) for i in range(6)]
    schema = "batch long, " + ", ".join(f"{m} double" for m in METRICS)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running_means(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = totals(spark.read.parquet(str(tmp_path / "out"))).first()
    assert (got.batches, got.count_avg, got.devs) == (6, 2.5, 3.0)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_are_a_permutation_over_many_ranges(spark, adaptive):
    n = 1_000_000
    table = spark.range(n).select(F.xxhash64("id").alias("key"), "id").repartition(9)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        placed = loader.numbered(table, "key", "id")
        found = placed.agg(F.count("*"), F.min("idx"), F.max("idx"), F.countDistinct("idx")).first()
        assert tuple(found) == (n, 0, n - 1, n)
        ordered = placed.select(F.floor(F.col("idx") / 1000).alias("k"), "key").groupBy("k").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("k").collect()
        assert all(a.hi < b.lo for a, b in zip(ordered, ordered[1:]))
        shuffled = loader.shuffled(placed.select("id", "idx"), 3, "id")
        assert tuple(shuffled.agg(F.count("*"), F.max("idx"), F.countDistinct("idx")).first()) == (n, n - 1, n)
        assert loader.batches(placed, 7).groupBy("batch").count().where("count != 7").count() == 0
        assert loader.rank_split(placed, 2, 3).count() == n // 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_loaded_pixels_follow_the_options(spark):
    pixels = images.embedding_pixels(spark, "/root/testdata/sf0.001").where("imgid < 3").select("imgid", "y", "x", "v")
    plain = loader.EngineOptions(img_size=8)
    assert sorted(map(tuple, loader.load_pixels(pixels, plain).collect())) == sorted(map(tuple, pixels.collect()))
    scaled = loader.load_pixels(pixels, loader.EngineOptions(img_size=8, img_resize=16, train_normalize=True)).collect()
    source = {(r.imgid, r.y, r.x): r.v for r in pixels.collect()}
    assert len(scaled) == 3 * 256 and all(abs(r.v - (source[r.imgid, r.y // 2, r.x // 2] * 2 - 1)) < 1e-9 for r in scaled)
    turned = loader.load_pixels(pixels, loader.EngineOptions(img_size=8, train_rotate=True, train_scale=(0.5, 1.0)))
    assert turned.count() == 3 * 64 and turned.where("v = -1").count() > 0
    assert loader.load_pixels(pixels, loader.EngineOptions(img_size=8, train_rotate=True), train=False).exceptAll(pixels).count() == 0


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from chordgrid.operators.storage import shared_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(sparkContext=context))
