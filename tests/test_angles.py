"""Angles of gradients that all but vanish, against the SQL twin."""

from __future__ import annotations

import math
import random

import duckdb
from pyspark.sql import functions as F

from chordgrid.functions.geometry import rounded
from chordgrid.plans import registry


def test_keypoints_of_gradients_that_round_to_zero_from_below(spark, tmp_path):
    chance = random.Random(5)
    rows = [(n, [chance.randrange(3) / 4 + chance.choice((0.0, 0.0, 2.0**-23, -(2.0**-23))) for _ in range(64)], 0) for n in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    found = registry.QUERIES["draw_keypoints"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({registry.ORACLE_SQL['draw_keypoints']})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert sum(row[3] == -180 for row in want) > 50


def test_rounding_is_that_of_the_twins(spark):
    values = [0.0, -0.0, 1e-8, -1e-8, 5e-7, -5e-7, 0.0078125, -0.0078125, 0.0234375, 1.0000005, -2.5e-6, 179.99999949, 1e300, -7.25, math.inf, -math.inf, math.nan]
    got = [r.v for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(rounded(F.col("v"), 6).alias("v")).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    same = lambda a, b: math.isnan(a) and math.isnan(b) or (a == b and math.copysign(1, a) == math.copysign(1, b))
    assert all(map(same, got, want)), list(zip(values, got, want))
