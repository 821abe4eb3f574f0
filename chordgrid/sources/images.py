"""Images as pixel tables: from arrays in Parquet, from folders of files, and from the binary formats of two public sets."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chordgrid.sources import png
from chordgrid.sources.loader import numbered

IMAGES = "imgid long, label int, h int, w int, c int, data array<float>"


def embedding_pixels(spark: SparkSession, sf_dir: str, side: int = 8) -> DataFrame:
    """(imgid, label, oid, y, x, v): each embedding of side*side floats read as a one-channel image."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.posexplode("embedding").alias("i", "value"))
    return table.select(
        F.col("vec_id").alias("imgid"), "label", (F.col("vec_id") * side * side + F.col("i")).alias("oid"),
        F.expr(f"cast(i div {side} as long)").alias("y"), (F.col("i") % side).cast("long").alias("x"), F.col("value").cast("double").alias("v"),
    )


def points(pixels: DataFrame, above: float = 0.1) -> DataFrame:
    """Dense to sparse: the pixels whose value exceeds ``above``."""
    return pixels.where(F.col("v") > above)


def pixels(images: DataFrame) -> DataFrame:
    """(imgid, label, ch, y, x, v) of images whose data is in channel, row, column order."""
    size = F.col("h") * F.col("w")
    cells = images.select("imgid", "label", "h", "w", F.posexplode("data").alias("i", "v"))
    return cells.select(
        "imgid", "label", F.floor(F.col("i") / size).cast("int").alias("ch"), F.floor((F.col("i") % size) / F.col("w")).cast("long").alias("y"),
        (F.col("i") % F.col("w")).cast("long").alias("x"), F.col("v").cast("double").alias("v"),
    )


def _netpbm(data: bytes) -> np.ndarray:
    """(h, w, c) of a binary PGM or PPM file with 8-bit samples."""
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    w, h, _ = fields
    c = {b"P5": 1, b"P6": 3}[data[:2]]
    return np.frombuffer(data, np.uint8, h * w * c, at + 1).reshape(h, w, c)


def decoded(data: bytes) -> np.ndarray:
    """(h, w, c) of an image file. Netpbm and PNG are read here, other formats by PIL where it is installed."""
    if data[:2] in (b"P5", b"P6"):
        return _netpbm(data)
    if data[:8] == png.SIGNATURE:
        return png.decoded(data)
    import io

    from PIL import Image

    image = np.asarray(Image.open(io.BytesIO(data)))
    return image if image.ndim == 3 else image[:, :, None]


def _coloured(image: np.ndarray, channels: int | None) -> np.ndarray:
    """An image with as many channels as wanted: grey is repeated, colours become their mean, transparency goes."""
    if channels is None or image.shape[2] == channels:
        return image
    solid = image[:, :, : 3 if image.shape[2] > 2 else 1]
    if channels == 1:
        return np.rint(solid.mean(2, keepdims=True)).astype(np.uint8)
    return np.repeat(solid, 3, 2) if solid.shape[2] == 1 else solid


def _folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content) of the files under a folder; name is the subfolder of the folder itself that a file is in, however deep."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inner = F.expr(f"substring(path, {len(root) + 2})")
    return files.withColumn("name", F.substring_index(inner, "/", 1)).where(F.contains(inner, F.lit("/")))


def class_list(spark: SparkSession, path: str) -> DataFrame:
    """(label, name) of an image folder's classes in sorted order."""
    names = numbered(_folder(spark, path).select("name").distinct(), "name")
    return names.select(F.col("idx").cast("int").alias("label"), "name")


def image_folder(spark: SparkSession, path: str, channels: int | None = None) -> DataFrame:
    """Images of a folder with one subfolder for each class; labels are the classes' places in sorted order.

    A path that doesn't exist raises Spark's AnalysisException. imgid is the place in the order of paths. ``channels``, 1 or
    3, makes all images alike; by default they keep their own.
    """
    files = _folder(spark, path)
    order = numbered(files.select("path"), "path").withColumnRenamed("idx", "imgid")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            arrays = [_coloured(decoded(content), channels) for content in batch.content]
            yield pd.DataFrame({
                "imgid": batch.imgid, "label": batch.label, "h": [a.shape[0] for a in arrays], "w": [a.shape[1] for a in arrays],
                "c": [a.shape[2] for a in arrays], "data": [(a.transpose(2, 0, 1).ravel() / np.float32(255)) for a in arrays],
            })

    labelled = files.join(order, "path").join(class_list(spark, path), "name").select("imgid", "label", "content")
    return labelled.mapInPandas(decode, IMAGES)


def tiny_imagenet(spark: SparkSession, data_dir: str, train: bool = True) -> DataFrame:
    """Images of one half of the tiny-imagenet folder, three channels each."""
    return image_folder(spark, f"{data_dir}/tiny-imagenet-200/{'train' if train else 'test'}", channels=3)


def fixed_records(spark: SparkSession, path: str, length: int, split_bytes: int = 64 << 20) -> DataFrame:
    """(at, data): the records of one file of records of ``length`` bytes with their offset, dealt to tasks by ranges of the file.

    A file whose size isn't a multiple of ``length`` raises an error.
    """
    settings = {"fixedlengthinputformat.record.length": str(length), "mapreduce.input.fileinputformat.split.maxsize": str(max(split_bytes, length))}
    pairs = spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=settings
    )
    return spark.createDataFrame(pairs, "at long, data binary")


def cifar10(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """Images of the binary CIFAR-10 files: records of one label byte and 3 * 32 * 32 samples."""
    size = 3 * 32 * 32

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            records = np.frombuffer(b"".join(batch.data), np.uint8).reshape(-1, size + 1)
            yield pd.DataFrame({"imgid": batch["first"] + batch["at"] // (size + 1), "label": records[:, 0].astype(np.int32), "h": 32, "w": 32, "c": 3, "data": list(records[:, 1:] / np.float32(255))})

    files = [row.path for row in spark.read.format("binaryFile").load(path).select("path").collect()]  # a few files
    tables = []
    for file in files:
        number = re.search(r"(\d+)\.bin$", file)
        tables.append(fixed_records(spark, file, size + 1, split_bytes).withColumn("first", F.lit(10_000 * int(number[1]) if number else 0).cast("long")))
    return reduce(DataFrame.unionByName, tables).mapInPandas(decode, IMAGES)


def mnist(spark: SparkSession, images: str, labels: str, split_bytes: int = 64 << 20) -> DataFrame:
    """Images of a pair of IDX files.

    The images' file is read in pieces that its head and an image both are a number of; pieces of an image meet by its number.
    """
    head = spark.read.format("binaryFile").load(images).select("length", F.substring("content", 1, 16).alias("head")).first()
    n, h, w = np.frombuffer(bytes(head.head), ">u4", 3, 4).tolist()
    size = math.gcd(16, h * w)
    piece = fixed_records(spark, images, size, split_bytes).where(F.col("at") >= 16)
    piece = piece.select(F.expr(f"(at - 16) div {h * w}").alias("imgid"), "at", "data").where(F.col("imgid") < n)
    whole = piece.groupBy("imgid").agg(F.array_sort(F.collect_list(F.struct("at", "data"))).alias("p"))  # the pieces of one image

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch.content:
                label = np.frombuffer(content, np.uint8, offset=8)
                yield pd.DataFrame({"imgid": np.arange(len(label)), "label": label.astype(np.int32)})

    names = spark.read.format("binaryFile").load(labels).select("content").mapInPandas(named, "imgid long, label int")  # a byte for each image

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            samples = [np.frombuffer(b"".join(parts), np.uint8) / np.float32(255) for parts in batch.parts]
            yield pd.DataFrame({"imgid": batch.imgid, "label": batch.label, "h": h, "w": w, "c": 1, "data": samples})

    return whole.join(names, "imgid").select("imgid", "label", F.col("p.data").alias("parts")).mapInPandas(decode, IMAGES)


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points off the lattice: image is the day, y the user, x the value."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("imgid"), F.col("event_id").alias("oid"), F.col("user_id").cast("double").alias("y"), F.col("value").alias("x"))
