"""Sharding by a two-pass external shuffle. DataFrame functions only.

Pass one scatters records into memory-sized buckets by a seeded hash of their number. Pass two brings each bucket
together, puts it in record order, shuffles it (Spark's ``shuffle`` is a Fisher-Yates shuffle), and writes it at the
bucket's place. Buckets are filled by record number, so equal texts or equal ids never gather in one of them. Their number
follows the bytes alone, and so does the number of partitions that they are brought together in, so neither the session's
number of partitions nor a run after a lost executor changes the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chordgrid.llm.common import RID, numbered

#: Buckets that a task brings together at most, one range of them, once there are over RANGES tasks for them.
RANGE_BUCKETS, RANGES = 32, 1024


def offsets(dealt: DataFrame) -> DataFrame:
    """(bucket, offset): the number of records in the buckets before it, summed in two levels."""
    counts = dealt.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("range", F.expr("bucket div 1024"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("range").agg(F.sum("n").alias("range_n"))
    ranges = ranges.select("range", F.coalesce(F.sum("range_n").over(before.orderBy("range")), F.lit(0)).alias("range_offset"))
    inner = F.coalesce(F.sum("n").over(before.partitionBy("range").orderBy("bucket")), F.lit(0))
    return counts.withColumn("inner", inner).join(ranges, "range").select("bucket", (F.col("range_offset") + F.col("inner")).alias("offset"))


def shard(df: DataFrame, size: Column, *, shards: int = 16, seed: int = 7, bucket_bytes: int = 8 << 20) -> DataFrame:
    """``row`` (all columns of ``df`` as a struct) with size, shard and slot: all rows in random order, cut in equal runs.

    The law is `rows`: shard sizes in rows differ by one at most, and slots count from 0 without gaps. ``df`` is read
    twice; its record numbers are the table's (``numbered``). Null, empty and very long texts are only sizes here; ties and repeated rows are records of their own; columns
    stay inside ``row``; an empty table gives an empty result, and fewer rows than shards leave the last shards empty.
    """
    row = F.struct(*[f"`{name}`" for name in df.columns]).alias("row")
    sized = numbered(df).select(F.col(RID).alias("rid"), row, size.cast("long").alias("size"))
    n, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, -(-total // bucket_bytes))
    dealt = sized.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "rid"), F.lit(buckets)))
    # two levels: ranges of buckets, one for each task, and buckets inside; in bucket order, so that the shuffle draws the same again
    ranges = min(buckets, max(RANGES, -(-buckets // RANGE_BUCKETS)))
    dealt = dealt.withColumn("range", F.expr(f"int(bucket * {ranges}L div {buckets}L)"))
    met = dealt.repartitionById(ranges, "range").groupBy("range", "bucket").agg(F.sort_array(F.collect_list(F.struct("rid", "size", "row"))).alias("records"))
    mixed = met.sortWithinPartitions("bucket").select("bucket", F.posexplode(F.shuffle("records", seed)).alias("pos", "record"))
    placed = mixed.join(offsets(dealt), "bucket").withColumn("place", F.col("offset") + F.col("pos"))
    least, longer = n // shards, n % shards
    cut = longer * (least + 1)
    shard_of = f"if(place < {cut}L, place div {least + 1}, {longer} + (place - {cut}L) div {max(1, least)})"
    slot_of = f"if(place < {cut}L, place % {least + 1}, (place - {cut}L) % {max(1, least)})"
    return placed.select(
        "record.row", "record.size", F.lit("rows").alias("law"), F.expr(shard_of).cast("int").alias("shard"), F.expr(slot_of).cast("long").alias("slot")
    )


def write_shards(sharded: DataFrame, path: str) -> DataFrame:
    """One folder for each shard under ``path``, and what they hold, read back: ``row`` with its size, law, shard and slot.

    A bucket's rows lie in one or two folders. What an input row holds (nulls, empty and very long texts, repeats) is
    written as it is; its columns stay inside ``row``, so none clashes with ``shard``; without rows there are no folders,
    and the result is empty.
    """
    sharded.write.partitionBy("shard").parquet(path)
    return sharded.sparkSession.read.schema(sharded.schema).parquet(path)
