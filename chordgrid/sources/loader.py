"""What a loader does to a table of images (idx, ...): subsets, ranks, batches, fixed images, resizing, metrics, options."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chordgrid.operators.gather import gathered
from chordgrid.operators.storage import stored

# The images that debugging shows again and again, and the one image of the one-image set.
DEBUG_IDS = (18803, 28702, 11915, 27372)
ONE_IMAGE = 17


# Names and defaults of the settings.
@dataclass(frozen=True)
class EngineOptions:
    """Settings of a run. Booleans are booleans; scales are pairs (least, most)."""

    exp_name: str = ""
    save_folder: str = ""
    debug: bool = True
    base_dataset: str = "art_arcs"
    data_dir: str = ""
    oneim_dataset: bool = False
    img_size: int = 32
    img_resize: int | None = None
    train_datamode: str = "train"
    test_datamode: str = "test"
    train_size: int | None = None
    test_size: int | None = None
    train_rotate: bool = False
    test_rotate: bool = False
    train_scale: tuple[float, float] | None = None
    test_scale: tuple[float, float] | None = None
    train_normalize: bool = False
    test_normalize: bool = False
    train_shuffle: bool = False
    test_shuffle: bool = True
    n_epochs: int = 20
    batch_size: int = 6
    save_freq: int | None = None
    load_from: str | None = None
    print_freq: int = 100

    def __post_init__(self) -> None:
        for name in ("train_scale", "test_scale"):
            pair = getattr(self, name)
            if pair is not None and not (len(pair) == 2 and pair[0] <= 1 + 1e-6):
                raise ValueError(f"{name} is a pair whose first number is at most 1")

    @property
    def channels(self) -> int:
        return 3 if self.base_dataset.replace("-", "_") in ("cifar", "tiny_imagenet") else 1

    @property
    def save_dir(self) -> str:
        return f"{self.save_folder}/{re.sub('[/.]+', '_', self.exp_name)}"

    def listing(self) -> list[str]:
        """Sorted lines, those that differ from the default marked."""
        rows = []
        for field in sorted(fields(self), key=lambda f: f.name):
            value = getattr(self, field.name)
            rows.append(f"{field.name}: {value}" + (f" [default: {field.default}]" if value != field.default else ""))
        return rows


def subset_size(length: int, wanted: int | None) -> int:
    """Rows of the first of equal parts: at least a hundredth of all, everything for None or 0."""
    if not wanted:
        return length
    parts = min(length // wanted, 100)
    if parts == 0:
        raise ValueError(f"{wanted} images are asked for, there are {length}")
    return length // parts


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with idx from 0 in the given order, counted in ranges so that no task sees all rows.

    The ranged table is stored with the number of each row's range: bounds are sampled, so another run of the same plan
    may cut other ranges, and offsets must be those of the very rows they number.
    """
    ranged = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    placed = ranged.withColumn("__rank", rank).join(F.broadcast(counts.select("__part", before.alias("__before"))), "__part", "left")  # a row for each range
    return placed.withColumn("idx", (F.col("__before") + F.col("__rank")).cast("long")).drop("__part", "__rank", "__before")


def subset(df: DataFrame, wanted: int | None) -> DataFrame:
    """The first part of a numbered table."""
    return df.where(F.col("idx") < subset_size(df.count(), wanted))


def rank_split(df: DataFrame, rank: int, world: int) -> DataFrame:
    """A rank's rows of a numbered table; the rest that doesn't divide is dropped."""
    size = df.count() // world
    return df.where((F.col("idx") < size * world) & (F.expr(f"idx div {max(1, size)}") == rank))


def shuffled(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """A numbered table in another order, by a hash of seed and keys."""
    order = df.drop("idx").withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])))
    return numbered(order, "__h", *keys).drop("__h")


def batches(df: DataFrame, size: int) -> DataFrame:
    """A numbered table with its batch; an incomplete last batch is dropped."""
    whole = df.count() // size * size
    return df.where(F.col("idx") < whole).withColumn("batch", F.expr(f"idx div {size}"))


def one_image(df: DataFrame, image: int = ONE_IMAGE) -> DataFrame:
    """A table as long as ``df`` whose every row is one image, with label 0."""
    length = df.count()
    chosen = df.where(F.col("idx") == image).drop("idx", "label")
    return df.sparkSession.range(length).withColumnRenamed("id", "idx").join(F.broadcast(chosen)).withColumn("label", F.lit(0))  # one row


def debug_images(df: DataFrame, ids: tuple[int, ...] = DEBUG_IDS) -> DataFrame:
    """A table as long as ``df`` that goes through a few images again and again."""
    spark, length = df.sparkSession, df.count()
    order = F.element_at(F.array(*[F.lit(i).cast("long") for i in ids]), (F.col("id") % len(ids) + 1).cast("int"))
    calls = spark.range(length).select(F.col("id").alias("call"), order.alias("idx"))
    return calls.join(F.broadcast(df.where(F.col("idx").isin(*ids))), "idx")  # as many rows as ids


def random_size(img_size: int, low: float, high: float, key: Column, seed: int = 1) -> Column:
    """A size between the bounds' shares of ``img_size``, by a hash of ``key``; odd sizes become even."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long") / 4294967296.0
    size = F.rint(img_size * (u * (high - low) + low)).cast("int")
    return size - size % 2


def debug_size(img_size: int, low: float, high: float, key: Column) -> Column:
    """One of four sizes in turn."""
    sizes = [int((low + (high - low) * i / 3) * img_size) for i in range(4)]
    return F.element_at(F.array(*[F.lit(s - s % 2) for s in sizes]), (key % 4 + 1).cast("int"))


def resized(pixels: DataFrame, side: int, low: float) -> DataFrame:
    """(imgid, size, y, x, v): images of ``side`` scaled to their ``size``, each target pixel from its nearest source.

    Around them lies a margin of -1, and the middle ``side`` by ``side`` is kept.
    """
    pad = side - int(side * low) + 1
    images = pixels.select("imgid", "size").distinct()
    cells = images.select("imgid", "size", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("i"))
    shift = F.expr(f"(size + {2 * pad} - {side}) div 2") - pad
    cells = cells.select("imgid", "size", F.expr(f"cast(i div {side} as long)").alias("y"), (F.col("i") % side).cast("long").alias("x"), shift.alias("shift"))
    source = {c: F.floor((2 * (F.col(c) + F.col("shift")) + 1) * side / (2 * F.col("size"))).cast("long").alias(f"s{c}") for c in "yx"}
    inside = [(F.col(c) + F.col("shift") >= 0) & (F.col(c) + F.col("shift") < F.col("size")) for c in "yx"]
    cells = cells.select("imgid", "size", "y", "x", *source.values(), (inside[0] & inside[1]).alias("inside"))
    values = pixels.select("imgid", F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    met = cells.join(values, ["imgid", "sy", "sx"], "left")
    return met.select("imgid", "size", "y", "x", F.when(F.col("inside"), F.col("v")).otherwise(-1.0).alias("v"))


def rotated(pixels: DataFrame, side: int, degrees: Column, mode: str = "bicubic", limits: tuple[float, float] | None = None) -> DataFrame:
    """(imgid, y, x, v): images turned counter-clockwise about their centre by an angle of each image; 0 where they don't reach.

    A target pixel takes the source's value at the place it comes from; what bicubic sums overshoot is cut at ``limits``.
    """
    c = (side - 1) / 2
    images = pixels.select("imgid", degrees.alias("angle")).distinct()
    cells = images.select("imgid", "angle", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("i"))
    y, x, a = F.floor(F.col("i") / side) - c, F.col("i") % side - c, F.radians("angle")
    places = cells.select("imgid", F.col("i").cast("long").alias("i"), (F.cos(a) * y + F.sin(a) * x + c).alias("y"), (F.cos(a) * x - F.sin(a) * y + c).alias("x"))
    found = gathered(pixels, places, ("i",), mode, side=side)
    v = F.col("v") if limits is None else F.least(F.greatest("v", F.lit(limits[0])), F.lit(limits[1]))
    return found.select("imgid", F.expr(f"i div {side}").alias("y"), (F.col("i") % side).alias("x"), v.alias("v"))


def transformed(pixels: DataFrame) -> DataFrame:
    """Values of 0 to 1 as -1 to 1."""
    return pixels.withColumn("v", (F.col("v") - 0.5) / 0.5)


def load_images(spark: SparkSession, images: DataFrame, options: EngineOptions, train: bool = True) -> DataFrame:
    """A numbered, cut, shuffled and batched table of images by the options of one split."""
    mode = "train" if train else "test"
    table = subset(numbered(images, "imgid"), getattr(options, f"{mode}_size"))
    if options.oneim_dataset:
        table = one_image(table)
    if getattr(options, f"{mode}_shuffle"):
        table = shuffled(table, 1, "imgid") if not options.oneim_dataset else table
    return batches(table, options.batch_size)


def resized_to(pixels: DataFrame, side: int, wanted: int) -> DataFrame:
    """(imgid, y, x, v): square images of ``side`` scaled to ``wanted``, each target pixel from its nearest source."""
    images = pixels.select("imgid").distinct()
    cells = images.select("imgid", F.explode(F.sequence(F.lit(0), F.lit(wanted * wanted - 1))).alias("i"))
    y, x = F.expr(f"i div {wanted}"), F.col("i") % wanted
    source = [F.floor((2 * c + 1) * side / (2 * wanted)).cast("long") for c in (y, x)]
    cells = cells.select("imgid", y.cast("long").alias("y"), x.cast("long").alias("x"), source[0].alias("sy"), source[1].alias("sx"))
    values = pixels.select("imgid", F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    return cells.join(values, ["imgid", "sy", "sx"]).select("imgid", "y", "x", "v")


def load_pixels(pixels: DataFrame, options: EngineOptions, train: bool = True, seed: int = 1) -> DataFrame:
    """Pixels (imgid, y, x, v) of square images of ``img_size`` after the transforms that one split's options name, in their order.

    Resizing to ``img_resize``, turning by an angle of each image within half a turn, values from -1 to 1, then a size of
    its own for each image. Without any of them the pixels stay as they are.
    """
    mode = "train" if train else "test"
    pixels, side = pixels.select("imgid", "y", "x", "v"), options.img_size
    if options.img_resize:
        pixels, side = resized_to(pixels, side, options.img_resize), options.img_resize
    if getattr(options, f"{mode}_rotate"):
        part = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("angle"), F.col("imgid").cast("string"))), 1, 8), 16, 10).cast("long")
        pixels = rotated(pixels, side, part / 4294967296.0 * 360.0 - 180.0, limits=(0.0, 1.0))
    if getattr(options, f"{mode}_normalize"):
        pixels = transformed(pixels)
    scale = getattr(options, f"{mode}_scale")
    if scale is not None:
        low, high = scale
        size = debug_size(side, low, high, F.col("imgid")) if options.debug else random_size(side, low, high, F.col("imgid"), seed)
        pixels = resized(pixels.withColumn("size", size), side, low).drop("size")
    return pixels


def load(images: DataFrame, pixels: DataFrame, options: EngineOptions, train: bool = True, seed: int = 1) -> DataFrame:
    """(batch, idx, imgid, label, y, x, v): what one split's options make of ``images`` (imgid, label) and their ``pixels``.

    The images are numbered, cut to the wanted part, replaced by one image, shuffled and batched, then each place's pixels are
    resized, turned, normalised and scaled. Angles and sizes go by the place, so an image that comes twice comes in two ways.
    """
    table = load_images(images.sparkSession, images.select("imgid", "label"), options, train)
    calls = table.select(F.col("idx").alias("call"), "imgid")
    placed = pixels.select("imgid", "y", "x", "v").join(calls, "imgid").select(F.col("call").alias("imgid"), "y", "x", "v")
    done = load_pixels(placed, options, train, seed).withColumnRenamed("imgid", "idx")
    return done.join(table.select("idx", "batch", "imgid", "label"), "idx").select("batch", "idx", "imgid", "label", "y", "x", "v")


def save_checkpoint(weights: DataFrame, folder: str, epoch: int, batch: int) -> str:
    """Weights (name, values) without samplers and edge detectors, under the epoch's and batch's name."""
    path = f"{folder}/epoch_{epoch}_batch_{batch}"
    weights.where(~F.col("name").startswith("sampler") & ~F.contains("name", F.lit("canny"))).write.mode("overwrite").parquet(path)
    return path


def load_checkpoint(current: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved values where a name is known to both, else the current ones."""
    return current.alias("c").join(saved.alias("s"), "name", "left").select("name", F.coalesce("s.values", "c.values").alias("values"))


def image_metrics(labelled: DataFrame) -> DataFrame:
    """(imgid, count_avg, n_ccpts, maxes, devs) of points with components: points, components, the largest, the sizes' deviation."""
    sizes = labelled.groupBy("imgid", "ccid").agg(F.count("*").alias("size"))
    return sizes.groupBy("imgid").agg(F.sum("size").alias("count_avg"), F.count("*").alias("n_ccpts"), F.max("size").alias("maxes"), F.stddev_pop("size").alias("devs"))
