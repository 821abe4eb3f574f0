"""Queries on pixels, points, neighbour graphs and their aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chordgrid.operators import canny, pooling
from chordgrid.operators.components import components, image_components, roots
from chordgrid.operators.neighbours import EIGHT, bipartite_neighbours, degrees, dense_neighbours, drop_coincident, endpoints, neighbours
from chordgrid.operators.unionfind import UnionFind
from chordgrid.plans.sql import COMPONENTS, DEGREES, ENDPOINTS, PIXELS, POINTS, STEPS, cells, edges, query
from chordgrid.sources.images import embedding_pixels, event_points, points
from chordgrid.sources.shapes import SHAPES, shape, shape_sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def registered(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin if there is one."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = points(embedding_pixels(spark, sf_dir)).select("imgid", "oid", "y", "x", "v")
    return found, neighbours(found, EIGHT)


@registered(query(POINTS, edges(), DEGREES, ENDPOINTS, select="""
    SELECT p.imgid, count(*) AS n_points, coalesce(max(e.n), 0)::BIGINT AS n_edges, count(en.oid) AS n_endpoints
    FROM pt p LEFT JOIN en ON en.oid = p.oid LEFT JOIN (SELECT imgid, count(*) AS n FROM ed GROUP BY 1) e ON e.imgid = p.imgid GROUP BY 1"""))
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each image its numbers of points, neighbour edges and endpoints."""
    found, links = graph(spark, sf_dir)
    ends = endpoints(found, links).groupBy("imgid").agg(F.count("*").alias("n_endpoints"))
    counts = found.groupBy("imgid").agg(F.count("*").alias("n_points"))
    edge_counts = links.groupBy("imgid").agg(F.count("*").alias("n_edges"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_edges", "n_endpoints")}
    return counts.join(edge_counts, "imgid", "left").join(ends, "imgid", "left").select("imgid", "n_points", *zero.values())


@registered(query(POINTS, select="SELECT imgid, oid, y, x, v FROM pt"))
def pixels_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(embedding_pixels(spark, sf_dir)).select("imgid", "oid", "y", "x", "v")


@registered(query(PIXELS, select="SELECT oid, CASE WHEN v > 0.1 THEN 1 ELSE 0 END AS v FROM px"))
def binarise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_pixels(spark, sf_dir).select("oid", (F.col("v") > 0.1).cast("boolean").cast("int").alias("v"))


@registered(query(PIXELS, select="""
    SELECT imgid, oid, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS v
    FROM (SELECT *, min(v) OVER (PARTITION BY imgid) AS lo, max(v) OVER (PARTITION BY imgid) AS hi FROM px)"""))
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.normalised(embedding_pixels(spark, sf_dir)).select("imgid", "oid", F.round("v", 6).alias("v"))


@registered(query(PIXELS, select="""
    SELECT oid, round(CASE WHEN min(v) OVER (PARTITION BY imgid) < -1e-4 THEN (v + 1) / 2 ELSE v END, 6) AS v FROM px"""))
def denormalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.denormalised(embedding_pixels(spark, sf_dir)).select("oid", F.round("v", 6).alias("v"))


@registered(query(PIXELS, select="SELECT round(min(v), 6) AS min_v, round(max(v), 6) AS max_v, round(avg(v), 6) AS mean_v FROM px"))
def mmm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pooling.statistics(embedding_pixels(spark, sf_dir), "v")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


for _name in SHAPES:

    def _shape(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        return shape(spark, name)

    QUERIES[f"shape_{_name}"], ORACLE_SQL[f"shape_{_name}"] = _shape, shape_sql(_name)


@registered(query(POINTS, edges(), select="SELECT imgid, lf, rt, round(d, 6) AS d FROM ed"))
def frnn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)[1].select("imgid", "lf", "rt", F.round("d", 6).alias("d"))


@registered(query(
    "pt AS (SELECT datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS imgid, event_id AS oid, CAST(user_id AS DOUBLE) AS y, value AS x FROM events)",
    edges(radius=2.0), select="SELECT CAST(imgid AS BIGINT) AS imgid, lf, rt FROM ed"))
def frnn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(event_points(spark, sf_dir), 2.0).select("imgid", "lf", "rt")


@registered(query(
    "pt AS MATERIALIZED (SELECT datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS imgid, event_id AS oid, CAST(user_id AS DOUBLE) AS y, value AS x FROM events)",
    edges(radius=25.0), select="SELECT CAST(imgid AS BIGINT) AS imgid, lf, rt, round(d, 6) AS d FROM ed"))
def frnn_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of events in wide cells, those with over eight points dealt into blocks."""
    return dense_neighbours(event_points(spark, sf_dir), 25.0, most=8).withColumn("d", F.round("d", 6))


@registered(query(POINTS, """lo AS (SELECT * FROM pt WHERE v <= 0.2), hi AS (SELECT * FROM pt WHERE v > 0.2)""", f"""
    lc AS MATERIALIZED (SELECT imgid, oid, y, x, cy + sy AS cy, cx + sx AS cx FROM ({cells("lo", EIGHT)}), {STEPS}), hc AS MATERIALIZED ({cells("hi", EIGHT)})""", select=f"""
    SELECT a.imgid, a.oid AS lf, b.oid AS rt, round(sqrt(CAST((a.y - b.y) ** 2 + (a.x - b.x) ** 2 AS DOUBLE)), 6) AS d FROM lc a JOIN hc b ON a.imgid = b.imgid AND a.cy = b.cy AND a.cx = b.cx
    WHERE (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= {EIGHT * EIGHT!r}"""))
def frnn_bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours between faint and bright points."""
    found = graph(spark, sf_dir)[0]
    return bipartite_neighbours(found.where("v <= 0.2"), found.where("v > 0.2"), EIGHT).withColumn("d", F.round("d", 6))


@registered(query(POINTS, edges(), edges(radius=3.0, name="wide"), DEGREES, COMPONENTS, recursive=True, select="""
    SELECT w.imgid, w.lf, w.rt FROM wide w JOIN cc a ON a.oid = w.lf JOIN cc b ON b.oid = w.rt WHERE a.ccid <> b.ccid"""))
def unrelated_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points within three pixels of each other that no chain of neighbours joins."""
    found, links = graph(spark, sf_dir)
    label = components(found, links).select("oid", "ccid")
    wide = neighbours(found, 3.0).select("imgid", "lf", "rt")
    wide = wide.join(label.select(F.col("oid").alias("lf"), F.col("ccid").alias("a")), "lf").join(label.select(F.col("oid").alias("rt"), F.col("ccid").alias("b")), "rt")
    return wide.where("a != b").select("imgid", "lf", "rt")


@registered(query(POINTS, edges(), DEGREES, select="SELECT imgid, oid, degree FROM dg"))
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees(*graph(spark, sf_dir))


@registered(query(POINTS, edges(), DEGREES, ENDPOINTS, select="SELECT imgid, oid FROM en"))
def endpoint_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoints(*graph(spark, sf_dir)).select("imgid", "oid")


@registered(query(PIXELS, """pt AS MATERIALIZED (SELECT imgid, oid, y * 0.7::DOUBLE AS y, x * 0.7::DOUBLE AS x FROM px WHERE v > 0.1)""", edges(radius=1.2),
    select="SELECT p.imgid, p.oid FROM pt p LEFT JOIN (SELECT DISTINCT lf FROM ed WHERE d * d < 0.9) c ON c.lf = p.oid WHERE c.lf IS NULL"))
def coincident_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points(embedding_pixels(spark, sf_dir)).select("imgid", "oid", (F.col("y") * 0.7).alias("y"), (F.col("x") * 0.7).alias("x"))
    return drop_coincident(found).select("imgid", "oid")


@registered(query(POINTS, edges(), DEGREES, COMPONENTS, recursive=True, select="SELECT imgid, oid, ccid FROM cc"))
def components_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_components(*graph(spark, sf_dir))


@registered(query(POINTS, edges(), DEGREES, COMPONENTS, recursive=True, select="SELECT ccid, count(*) AS size FROM cc GROUP BY 1"))
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(*graph(spark, sf_dir)).groupBy("ccid").agg(F.count("*").alias("size"))


@registered("""
    WITH n AS (SELECT o_custkey AS c, 2 * o_orderkey + 1 AS node FROM orders UNION SELECT o_custkey, 2 * o_custkey FROM orders),
    r AS (SELECT c, min(node) AS root FROM n GROUP BY 1)
    SELECT node, root FROM n JOIN r USING (c) WHERE node <> root""")
def uf_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of links from orders to customers, in two id spaces."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return roots(orders.select((2 * F.col("o_orderkey") + 1).alias("lf"), (2 * F.col("o_custkey")).alias("rt")))


def supplier_forest(spark: SparkSession, sf_dir: str) -> UnionFind:
    """Suppliers in order of their keys, those of one nation joined in turn."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("x"), F.col("s_nationkey").alias("nation"))
    before = F.lag("x").over(Window.partitionBy("nation").orderBy("x"))
    pairs = suppliers.select("x", before.alias("y"), F.col("x").alias("order")).where("y is not null")
    return UnionFind.of(spark).add(suppliers.select("x", F.col("x").alias("order"))).union(pairs)


# the first link of two single suppliers keeps the root of its first one, the second supplier; later ones join the larger set
_FOREST = """su AS (SELECT s_suppkey AS x, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, s_nationkey AS nation FROM supplier),
    ro AS (SELECT nation, list_sort(list(idx)) AS l FROM su GROUP BY 1),
    fo AS (SELECT x, idx, nation, l[least(len(l), 2)] AS root FROM su JOIN ro USING (nation))"""


@registered(f"WITH {_FOREST} SELECT x, idx, root FROM fo")
def uf_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_forest(spark, sf_dir).labelled().select("x", "idx", "root")


@registered("""
    WITH RECURSIVE li AS (SELECT o_custkey AS c, 2 * o_orderkey + 1 AS node FROM orders UNION SELECT o_custkey, 2 * o_custkey FROM orders)
    SELECT node AS x, min(node) OVER (PARTITION BY c) AS least, count(*) OVER (PARTITION BY c) AS size FROM li""")
def uf_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders linked to customers in two batches, each a version of the forest."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    pairs = orders.select((2 * F.col("o_orderkey") + 1).alias("x"), (2 * F.col("o_custkey")).alias("y"), F.col("o_orderkey").alias("order"), (F.col("o_orderkey") % 2).alias("batch"))
    forest = UnionFind.of(spark)
    for batch in range(2):
        forest = forest.union(pairs.where(F.col("batch") == batch).drop("batch"))
    of = forest.labelled()
    sets = of.groupBy("root").agg(F.min("x").alias("least"), F.count("*").alias("size"))
    return of.join(sets, "root").select("x", "least", "size")


@registered(f"WITH {_FOREST} SELECT a.x, b.x AS y, a.root = b.root AS connected FROM fo a JOIN fo b ON b.x = a.x + 1")
def uf_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = supplier_forest(spark, sf_dir)
    return forest.connected(forest.elements.select("x", (F.col("x") + 1).alias("y"))).where("connected is not null")


@registered(f"WITH {_FOREST} SELECT root, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS members FROM fo GROUP BY 1")
def uf_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = supplier_forest(spark, sf_dir).components()
    return found.select("root", F.concat_ws(",", F.col("members").cast("array<string>")).alias("members"))


@registered(f"WITH {_FOREST} SELECT x, count(*) OVER (PARTITION BY root) AS size, min(x) OVER (PARTITION BY root) AS least FROM fo")
def uf_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = supplier_forest(spark, sf_dir).component_mapping()
    return found.select("x", F.size("members").cast("long").alias("size"), F.array_min("members").alias("least"))


@registered("SELECT p_partkey AS node, p_partkey // 8 * 8 AS root FROM part WHERE p_partkey % 8 <> 0")
def uf_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of eight parts, each linked to the one before: the worst shape for label spreading."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("lf"))
    return roots(parts.where("lf % 8 != 0").select("lf", (F.col("lf") - 1).alias("rt")))


@registered(query(POINTS, select="""
    SELECT e.vec_id AS imgid, round(coalesce(avg(p.v), 0), 6) AS v FROM embeddings e LEFT JOIN pt p ON p.imgid = e.vec_id GROUP BY 1"""))
def avg_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = embedding_pixels(spark, sf_dir)
    return pooling.avg_pool(points(pixels), "v", pixels.select("imgid").distinct()).select("imgid", F.round("v", 6).alias("v"))


@registered(query(POINTS, select="""
    SELECT e.vec_id AS imgid, round(coalesce(sum(p.v), 0), 6) AS v FROM embeddings e LEFT JOIN pt p ON p.imgid = e.vec_id GROUP BY 1"""))
def sum_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = embedding_pixels(spark, sf_dir)
    return pooling.sum_pool(points(pixels), "v", pixels.select("imgid").distinct()).select("imgid", F.round("v", 6).alias("v"))


_HITS = """ht AS (SELECT imgid, CAST(least(greatest(round_even(y * 0.7, 0), 0), 5) AS BIGINT) AS y, CAST(least(greatest(round_even(x * 0.7, 0), 0), 5) AS BIGINT) AS x,
        sum(v) AS s, count(*) AS n FROM pt GROUP BY 1, 2, 3),
    ce AS (SELECT imgid, i // 6 AS y, i % 6 AS x FROM (SELECT DISTINCT imgid FROM pt), range(36) t(i))"""


@registered(query(POINTS, _HITS, select="""
    SELECT imgid, y, x, round(coalesce(s, 0) / (coalesce(n, 0) + 1), 6) AS v FROM ce LEFT JOIN ht USING (imgid, y, x)"""))
def regrid_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph(spark, sf_dir)[0].withColumn("y", F.col("y") * 0.7).withColumn("x", F.col("x") * 0.7)
    return pooling.regrid(found, "v", 6).withColumn("v", F.round("v", 6))


@registered(query(POINTS, _HITS, select="SELECT imgid, y, x, round(coalesce(s, 0), 6) AS v FROM ce LEFT JOIN ht USING (imgid, y, x)"))
def regrid_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph(spark, sf_dir)[0].withColumn("y", F.col("y") * 0.7).withColumn("x", F.col("x") * 0.7)
    return pooling.regrid(found, "v", 6, average=False).withColumn("v", F.round("v", 6))


_PACKED = """it AS (SELECT c.imgid, c.ccid, c.oid, p.y, p.x, p.v, row_number() OVER (PARTITION BY c.ccid ORDER BY c.oid) - 1 AS r
        FROM cc c JOIN pt p ON p.oid = c.oid),
    fl AS (SELECT imgid, ccid, k, CASE k % 3 WHEN 0 THEN y WHEN 1 THEN x ELSE round(v, 6) END AS f
        FROM it, range(3) q(j), LATERAL (SELECT r * 3 + j AS k) WHERE k < 350)"""


@registered(query(POINTS, edges(), DEGREES, COMPONENTS, _PACKED, recursive=True, select="""
    SELECT c.imgid, c.ccid, CAST(i AS INTEGER) AS place, CAST(coalesce(f.f, 0) AS DOUBLE) AS feature
    FROM (SELECT DISTINCT imgid, ccid FROM cc) c CROSS JOIN range(350) t(i) LEFT JOIN fl f ON f.ccid = c.ccid AND f.k = i"""))
def stack_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, links = graph(spark, sf_dir)
    items = components(found.withColumn("v", F.round("v", 6)), links)
    packed = pooling.stack_bind(items, ["y", "x", "v"], 350)
    return packed.select("imgid", "ccid", F.posexplode("packed").alias("place", "feature"))


@registered(query(POINTS, edges(), DEGREES, select="""
    SELECT oid, round(avg(d), 6) AS mean_d FROM (SELECT lf AS oid, d FROM ed UNION ALL SELECT rt, d FROM ed) GROUP BY 1"""))
def mean_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.mean_neighbour_distance(graph(spark, sf_dir)[1]).select("oid", F.round("mean_d", 6).alias("mean_d"))


_SOBEL = """sh AS MATERIALIZED (SELECT imgid, y - sy AS y, x - sx AS x, sy AS a, sx AS b, v FROM px, (SELECT s // 3 - 1 AS sy, s % 3 - 1 AS sx FROM range(9) t(s))),
    pd AS MATERIALIZED (SELECT p.imgid, p.oid, p.y, p.x, q.a, q.b, q.v FROM px p JOIN sh q ON p.imgid = q.imgid AND p.y = q.y AND p.x = q.x),
    so AS MATERIALIZED (SELECT imgid, oid, y, x, sum(a * (2 - abs(b)) * v) AS dy, sum(b * (2 - abs(a)) * v) AS dx FROM pd GROUP BY 1, 2, 3, 4)"""


@registered(query(PIXELS, _SOBEL, select="SELECT imgid, oid, round(dy, 6) AS dy, round(dx, 6) AS dx FROM so"))
def sobel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canny.sobel(embedding_pixels(spark, sf_dir)).select("imgid", "oid", F.round("dy", 6).alias("dy"), F.round("dx", 6).alias("dx"))


_THIN = """mg AS (SELECT imgid, oid, y, x, round(dy, 6) AS dy, round(dx, 6) AS dx, round(sqrt(dy * dy + dx * dx), 6) AS m FROM so),
    st AS (SELECT *, CASE WHEN abs(dy) <= 0.41421356 * abs(dx) THEN 0 ELSE 1 END AS sy,
               CASE WHEN abs(dy) <= 0.41421356 * abs(dx) THEN 1 WHEN abs(dy) >= 2.41421356 * abs(dx) THEN 0 ELSE CAST(sign(dy) * sign(dx) AS INTEGER) END AS sx FROM mg),
    nm AS (SELECT s.imgid, s.oid, s.y, s.x, s.m FROM st s LEFT JOIN mg a ON a.imgid = s.imgid AND a.y = s.y + s.sy AND a.x = s.x + s.sx
               LEFT JOIN mg b ON b.imgid = s.imgid AND b.y = s.y - s.sy AND b.x = s.x - s.sx
           WHERE s.m > 0 AND s.m >= coalesce(a.m, 0) AND s.m > coalesce(b.m, 0))"""


def _canny_sql(low: float, high: float) -> str:
    """Edge pixels over the low threshold that reach one over the high."""
    strong = f"""wk AS (SELECT * FROM nm WHERE m > {low!r}),
    strong(oid) AS (SELECT oid FROM wk WHERE m > {high!r}
        UNION SELECT n.oid FROM strong r JOIN wk p ON p.oid = r.oid JOIN wk n ON n.imgid = p.imgid AND abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1)"""
    return query(PIXELS, _SOBEL, _THIN, strong, recursive=True, select="SELECT w.imgid, w.oid, w.m FROM wk w JOIN strong s ON s.oid = w.oid")


@registered(_canny_sql(0.0, 0.1))
def canny_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges at the thresholds of pyramids, segments and interpolation."""
    return canny.canny(embedding_pixels(spark, sf_dir), 0.0, 0.1).select("imgid", "oid", "m")


@registered(_canny_sql(0.1, 0.1))
def canny_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges at the one threshold of the string models."""
    return canny.canny(embedding_pixels(spark, sf_dir), 0.1, 0.1).select("imgid", "oid", "m")


@registered(_canny_sql(0.5, 0.9))
def canny_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canny.canny(embedding_pixels(spark, sf_dir), 0.5, 0.9).select("imgid", "oid", "m")


@registered(query(PIXELS, select="""
    SELECT label, count(DISTINCT imgid) AS images, round(avg(v), 6) AS mean_v FROM px GROUP BY 1"""))
def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_pixels(spark, sf_dir).groupBy("label").agg(F.countDistinct("imgid").alias("images"), F.round(F.avg("v"), 6).alias("mean_v"))


@registered(query(POINTS, select="""
    SELECT imgid // 50 AS batch, count(*) AS points, round(sum(count(*)) OVER (ORDER BY imgid // 50) / (row_number() OVER (ORDER BY imgid // 50)), 6) AS running FROM pt GROUP BY 1"""))
def running_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each batch of 50 images, and the running mean over the batches."""
    counts = graph(spark, sf_dir)[0].groupBy(F.expr("imgid div 50").alias("batch")).agg(F.count("*").alias("points"))
    order = Window.orderBy("batch")
    running = F.sum("points").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.row_number().over(order)
    return counts.select("batch", "points", F.round(running, 6).alias("running"))
