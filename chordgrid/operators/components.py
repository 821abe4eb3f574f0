"""Connected components of an edge table (lf, rt), labelled by the least member."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chordgrid.operators.storage import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("rt").alias("lf"), F.col("lf").alias("rt")))
    least = both.groupBy("lf").agg(F.min("rt").alias("m")).select("lf", F.least("lf", "m").alias("m"))
    return both.where("rt > lf").join(least, "lf").where("rt != m").select(F.col("rt").alias("lf"), F.col("m").alias("rt")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node, and its smaller neighbours, move to the least of them."""
    least = edges.groupBy("lf").agg(F.min("rt").alias("m"))
    moved = edges.join(least, "lf").where("rt != m").select(F.col("rt").alias("lf"), F.col("m").alias("rt"))
    return moved.unionByName(least.select("lf", F.col("m").alias("rt"))).distinct()


def roots(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` that isn't a root itself.

    Large-star and small-star steps alternate until every node has one edge, to a node that has none itself. The edge
    table stays distributed and is written to shared storage each round; only whether it is settled comes to the driver.
    """
    edges = edges.select(F.greatest("lf", "rt").alias("lf"), F.least("lf", "rt").alias("rt")).where("lf != rt").distinct()
    for _ in range(rounds):
        edges = stored(_small_star(_large_star(edges)), "components")
        ends = edges.select(F.col("lf").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.union(edges.select("rt", F.lit(0), F.lit(1)))
        unsettled = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
        if unsettled.isEmpty():
            return edges.select(F.col("lf").alias("node"), F.col("rt").alias("root"))
    raise RuntimeError("components have not settled")


def _least_members(_key: tuple, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """(imgid, oid, ccid) of whole images: each point takes the least label that its links lead to, until none changes."""
    own = own.sort_values("oid", ignore_index=True)
    oids = own["oid"].to_numpy()
    a, b = (np.searchsorted(oids, links[c].to_numpy()) for c in ("lf", "rt"))
    label = np.arange(len(oids))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            return pd.DataFrame({"imgid": own["imgid"], "oid": oids, "ccid": oids[label]})
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]


def components(points: DataFrame, edges: DataFrame, *, whole: int = 1_000_000, block: int = 100_000) -> DataFrame:
    """``points`` (imgid, oid, ...) with ccid, the least oid of the component; edges (imgid, lf, rt) stay within an image.

    Images of at most ``whole`` points are labelled in one pass, some of them, about ``block`` points, in a task; larger ones
    by rounds over their edge table.
    """
    sizes = stored(points.groupBy("imgid").count(), "image-sizes")
    total = sizes.agg(F.sum("count"), F.max("count")).first()
    if total[0] is None:
        return points.withColumn("ccid", F.col("oid"))
    # fresh column ids: both sides may come from one frame
    own, links = points.select("imgid", "oid"), edges.select(F.col("imgid").alias("image"), "lf", "rt").withColumnRenamed("image", "imgid")
    large = None
    if total[1] > whole:
        names = sizes.where(F.col("count") > whole).select("imgid")
        large = roots(links.join(names, "imgid", "left_semi").select("lf", "rt")).select(F.col("node").alias("oid"), F.col("root").alias("ccid"))
        own, links = own.join(names, "imgid", "left_anti"), links.join(names, "imgid", "left_anti")
    key = F.pmod(F.xxhash64("imgid"), F.lit(-(-total[0] // block))).alias("block")
    grouped = own.select(key, "imgid", "oid").groupBy("block").cogroup(links.select(key, "lf", "rt").groupBy("block"))
    found = grouped.applyInPandas(_least_members, "imgid long, oid long, ccid long").select("oid", "ccid")
    found = found if large is None else found.unionByName(large)
    return points.join(found, "oid", "left").withColumn("ccid", F.coalesce("ccid", "oid"))


def image_components(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(imgid, oid, ccid) where edges stay within images and an image fits a task: one pass, one group for each image."""

    def label(_key, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        parent = {o: o for o in own.oid}

        def find(o: int) -> int:
            while parent[o] != o:
                parent[o] = parent[parent[o]]
                o = parent[o]
            return o

        for a, b in zip(links.lf, links.rt):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return pd.DataFrame({"imgid": own.imgid, "oid": own.oid, "ccid": [find(o) for o in own.oid]})

    # fresh column ids: both sides may come from one frame
    links = edges.select(F.col("imgid").alias("image"), "lf", "rt").withColumnRenamed("image", "imgid")
    grouped = points.select("imgid", "oid").groupBy("imgid").cogroup(links.groupBy("imgid"))
    return grouped.applyInPandas(label, "imgid long, oid long, ccid long")
