"""Queries on loader semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chordgrid.operators.components import components
from chordgrid.plans.point_queries import graph
from chordgrid.plans.sql import COMPONENTS, DEGREES, PIXELS, POINTS, edges, query
from chordgrid.sources import loader
from chordgrid.sources.images import embedding_pixels

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _registered(sql: str):
    def register(function):
        QUERIES[function.__name__], ORACLE_SQL[function.__name__] = function, sql
        return function

    return register


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.numbered(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey"), "c_custkey")


_NUMBERED = "nu AS (SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_custkey) - 1 AS idx, count(*) OVER () AS n FROM customer)"


@_registered(f"WITH {_NUMBERED} SELECT c_custkey, idx FROM nu WHERE idx < n // least(n // 40, 100)")
def subset_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.subset(_customers(spark, sf_dir), 40).select("c_custkey", "idx")


@_registered(f"WITH {_NUMBERED} SELECT c_custkey, idx FROM nu WHERE idx < n // 7 * 7 AND idx // (n // 7) = 3")
def rank_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.rank_split(_customers(spark, sf_dir), 3, 7).select("c_custkey", "idx")


@_registered(f"WITH {_NUMBERED} SELECT c_custkey, idx, idx // 64 AS batch FROM nu WHERE idx < n // 64 * 64")
def batches_drop_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.batches(_customers(spark, sf_dir), 64).select("c_custkey", "idx", "batch")


@_registered("SELECT c_custkey, row_number() OVER (ORDER BY md5('1|' || c_custkey), c_custkey) - 1 AS idx FROM customer")
def shuffled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.shuffled(_customers(spark, sf_dir), 1, "c_custkey").select("c_custkey", "idx")


@_registered(f"WITH {_NUMBERED} SELECT i AS idx, c_custkey, 0 AS label FROM nu, (SELECT idx AS i FROM nu) WHERE idx = 17")
def one_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.one_image(_customers(spark, sf_dir)).select("idx", "c_custkey", "label")


@_registered(f"WITH {_NUMBERED} SELECT c.idx AS call, d.idx, d.c_custkey FROM nu c JOIN nu d ON d.idx = [88, 3, 119, 27][c.idx % 4 + 1]")
def debug_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.debug_images(_customers(spark, sf_dir), (88, 3, 119, 27)).select("call", "idx", "c_custkey")


@_registered("SELECT vec_id AS imgid, [4, 4, 6, 8][vec_id % 4 + 1] AS size FROM embeddings")
def debug_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select(F.col("vec_id").alias("imgid"), loader.debug_size(8, 0.5, 1.0, F.col("vec_id")).alias("size"))


@_registered("""
    SELECT imgid, size - size % 2 AS size FROM (
        SELECT vec_id AS imgid, round_even(8 * (('0x' || substr(md5('1|' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 0.5::DOUBLE + 0.5::DOUBLE), 0)::INTEGER AS size FROM embeddings)""")
def random_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select(F.col("vec_id").alias("imgid"), loader.random_size(8, 0.5, 1.0, F.col("vec_id")).alias("size"))


@_registered(query(PIXELS, """
    sz AS (SELECT DISTINCT imgid, [4, 4, 6, 8][imgid % 4 + 1] AS size FROM px),
    ce AS (SELECT imgid, size, i // 8 AS y, i % 8 AS x, (size + 2) // 2 - 5 AS sh FROM sz, range(64) t(i)),
    so AS (SELECT *, y + sh >= 0 AND y + sh < size AND x + sh >= 0 AND x + sh < size AS inside,
        CAST(floor((2 * (y + sh) + 1) * 8 / (2.0 * size)) AS BIGINT) AS sy, CAST(floor((2 * (x + sh) + 1) * 8 / (2.0 * size)) AS BIGINT) AS sx FROM ce)""",
    select="""SELECT s.imgid, s.y, s.x, CASE WHEN s.inside THEN round(p.v, 6) ELSE -1 END AS v
    FROM so s LEFT JOIN px p ON p.imgid = s.imgid AND p.y = s.sy AND p.x = s.sx"""))
def resize_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = embedding_pixels(spark, sf_dir).withColumn("size", loader.debug_size(8, 0.5, 1.0, F.col("imgid")))
    return loader.resized(pixels, 8, 0.5).select("imgid", "y", "x", F.round("v", 6).alias("v"))


@_registered(query(PIXELS, """
    ce AS (SELECT DISTINCT imgid, i // 8 AS y, i % 8 AS x FROM px, range(64) t(i))""",
    select="""SELECT c.imgid, c.y, c.x, round(p.v, 6) AS v FROM ce c JOIN px p ON p.imgid = c.imgid AND p.y = c.x AND p.x = 7 - c.y"""))
def rotated_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.rotated(embedding_pixels(spark, sf_dir), 8, F.lit(90.0), "nearest").select("imgid", "y", "x", F.round("v", 6).alias("v"))


_CUBIC = "CASE k WHEN 0 THEN -d * (1 - d) * (1 - d) WHEN 1 THEN 1 - d * d * (2 - d) WHEN 2 THEN d * (1 + d * (1 - d)) ELSE -d * d * (1 - d) END"


@_registered(query(PIXELS, f"""
    ce AS (SELECT imgid, i // 8 AS y, i % 8 AS x, radians(imgid % 360 + 0.5::DOUBLE) AS a FROM (SELECT DISTINCT imgid FROM px), range(64) t(i)),
    so AS (SELECT imgid, y, x, cos(a) * (y - 3.5::DOUBLE) + sin(a) * (x - 3.5::DOUBLE) + 3.5::DOUBLE AS sy, cos(a) * (x - 3.5::DOUBLE) - sin(a) * (y - 3.5::DOUBLE) + 3.5::DOUBLE AS sx FROM ce),
    ty AS (SELECT imgid, y, x, sy, sx, CAST(floor(sy) AS BIGINT) + k - 1 AS py, {_CUBIC} AS wy FROM (SELECT *, sy - floor(sy) AS d FROM so), range(4) t(k)),
    tx AS (SELECT imgid, y, x, sy, sx, py, wy, CAST(floor(sx) AS BIGINT) + k - 1 AS px_, {_CUBIC} AS wx FROM (SELECT *, sx - floor(sx) AS d FROM ty), range(4) t(k))""", select="""
    SELECT t.imgid, t.y, t.x, round(CASE WHEN min(sy) >= -0.5 AND min(sy) < 7.5 AND min(sx) >= -0.5 AND min(sx) < 7.5 THEN sum(t.wy * t.wx * p.v) ELSE 0 END, 5) + 0.0 AS v
    FROM tx t JOIN px p ON p.imgid = t.imgid AND p.y = least(greatest(t.py, 0), 7) AND p.x = least(greatest(t.px_, 0), 7) GROUP BY 1, 2, 3"""))
def rotated_bicubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image turned by an angle of its own, by cubic convolution."""
    found = loader.rotated(embedding_pixels(spark, sf_dir), 8, F.col("imgid") % 360 + 0.5)
    return found.select("imgid", "y", "x", (F.round("v", 5) + 0.0).alias("v"))


@_registered(query(PIXELS, select="SELECT oid, round((v - 0.5) / 0.5, 6) AS v FROM px"))
def transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.transformed(embedding_pixels(spark, sf_dir)).select("oid", F.round("v", 6).alias("v"))


@_registered(query(PIXELS, """
    nu AS (SELECT vec_id AS imgid, label, row_number() OVER (ORDER BY md5('1|' || vec_id), vec_id) - 1 AS idx, count(*) OVER () AS n FROM embeddings),
    ca AS (SELECT imgid, label, idx, idx // 6 AS batch, [4, 4, 6, 8][idx % 4 + 1] AS size FROM nu WHERE idx < n // 6 * 6),
    ce AS (SELECT *, i // 8 AS y, i % 8 AS x, (size + 2) // 2 - 5 AS sh FROM ca, range(64) t(i)),
    so AS (SELECT *, y + sh >= 0 AND y + sh < size AND x + sh >= 0 AND x + sh < size AS inside,
        CAST(floor((2 * (y + sh) + 1) * 8 / (2.0 * size)) AS BIGINT) AS sy, CAST(floor((2 * (x + sh) + 1) * 8 / (2.0 * size)) AS BIGINT) AS sx FROM ce)""",
    select="""SELECT s.batch, s.idx, s.imgid, s.label, s.y, s.x, CASE WHEN s.inside THEN round((p.v - 0.5) / 0.5, 6) ELSE -1 END AS v
    FROM so s LEFT JOIN px p ON p.imgid = s.imgid AND p.y = s.sy AND p.x = s.sx"""))
def loaded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One split by its options: shuffled, in batches of six, normalised, each place in a size of its own."""
    options = loader.EngineOptions(img_size=8, train_shuffle=True, train_normalize=True, train_scale=(0.5, 1.0))
    pixels = embedding_pixels(spark, sf_dir)
    return loader.load(pixels.select("imgid", "label").distinct(), pixels, options).withColumn("v", F.round("v", 6))


@_registered(query(POINTS, edges(), DEGREES, COMPONENTS, recursive=True, select="""
    SELECT imgid, CAST(sum(size) AS BIGINT) AS count_avg, count(*) AS n_ccpts, max(size) AS maxes, round(stddev_pop(size), 6) AS devs
    FROM (SELECT imgid, ccid, count(*) AS size FROM cc GROUP BY 1, 2) GROUP BY 1"""))
def image_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.image_metrics(components(*graph(spark, sf_dir))).withColumn("devs", F.round("devs", 6))
