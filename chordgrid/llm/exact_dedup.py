"""Exact deduplication by an extendible-hash index that lives in shared files. DataFrame functions only.

Records go to shared storage as hashes and row numbers, without their texts. The directory maps the leading bits of the hash
to buckets: it starts with one bucket and doubles while a bucket holds too many records, so a bucket is a range of hashes.
What no doubling parts, many records of few hashes, spills over to pages of its bucket, dealt by row number. Buckets and
their pages own the work: texts move to the owner of theirs, where equal hashes chain and texts are compared byte by
byte, so a text with a third of all rows is as many pages as it fills. The owners' entries, merged over the pages of a
bucket, are the index; the way back to the rows is an equi-join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chordgrid.llm.common import BLANKS, RID, numbered, shuffle_partitions, stored, text_of


#: Bits up to which the directory, one short row for each cell, is broadcast; a larger one is joined.
BROADCAST_BITS = 19


def normalised(text: str) -> Column:
    return F.regexp_replace(text_of(text), BLANKS, " ")


def directory(records: DataFrame, n_rows: int, bucket_rows: int) -> tuple[DataFrame, int]:
    """(cell, bucket, depth, pages) for each cell of the leading bits of ``h``, and the number of bits.

    Depths 0 to the full depth are the successive doublings; a cell belongs to the first whose bucket holds at most
    ``bucket_rows`` records, however many rows there are; a bucket that is overfull at the full depth has several pages.
    """
    bits = max(1, (n_rows // bucket_rows).bit_length() + 3)
    cells = records.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("cell")).agg(F.count("*").alias("n"))
    tries = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    tries = tries.withColumn("bucket", F.expr(f"(cell div shiftleft(1L, {bits} - depth)) * shiftleft(1L, {bits} - depth)"))
    loads = tries.groupBy("depth", "bucket").agg(F.sum("n").alias("load"))
    fits = loads.where((F.col("load") <= bucket_rows) | (F.col("depth") == bits))
    chosen = tries.join(fits, ["depth", "bucket"]).groupBy("cell").agg(F.min(F.struct("depth", "bucket", "load")).alias("c"))
    return chosen.select("cell", "c.bucket", "c.depth", F.ceil(F.col("c.load") / bucket_rows).alias("pages")), bits


def index(texts: DataFrame, records: DataFrame, bucket_rows: int) -> DataFrame:
    """The stored index: one entry (bucket, depth, h, sha, keep_id, group_size) for each distinct text, made by its owner."""
    cells, bits = directory(records, records.count(), bucket_rows)
    cells = stored(cells, "hash-directory")
    if bits <= BROADCAST_BITS:
        cells = F.broadcast(cells)
    keyed = texts.select("rid", F.shiftrightunsigned("h", 64 - bits).alias("cell"), "h", "norm", "id").join(cells, "cell")
    keyed = keyed.withColumn("page", F.pmod(F.xxhash64("rid"), "pages"))
    owned = keyed.repartition(shuffle_partitions(records.sparkSession), "bucket", "page")
    chains = owned.groupBy("bucket", "page", "depth", "pages", "h", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    paged = chains.where("pages > 1").groupBy("bucket", "depth", "h", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    columns = ["bucket", "depth", "h", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size"]
    return stored(chains.where("pages = 1").select(columns).unionByName(paged.select(columns)), "hash-index")


def verdicts(df: DataFrame, doc_id: str, text: str, bucket_rows: int) -> DataFrame:
    """(rid, keep_id, group_size, kept, text_sha256) for each row of a numbered ``df``; no texts."""
    texts = df.select(
        F.col(RID).alias("rid"), F.col(doc_id).cast("long").alias("id"), normalised(text).alias("norm")
    ).withColumn("h", F.xxhash64("norm"))
    records = stored(texts.select("rid", "id", "h", F.sha2("norm", 256).alias("sha")), "records")
    entries = index(texts, records, bucket_rows)
    groups = entries.where("group_size > 1").select("h", "sha", "keep_id", "group_size")
    repeats = (
        records.groupBy("h", "sha", "id")
        .agg(F.min("rid").alias("first_rid"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("h").alias("rh"), F.col("sha").alias("rsha"), F.col("id").alias("r_id"), "first_rid")
    )
    same = (F.col("h") == F.col("rh")) & (F.col("sha") == F.col("rsha")) & F.col("id").eqNullSafe(F.col("r_id"))
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return (
        records.join(groups, ["h", "sha"], "left")
        .join(repeats, same, "left")
        .select(
            "rid",
            keep_id.alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (F.col("id").eqNullSafe(keep_id) & (F.col("rid") == F.coalesce("first_rid", "rid"))).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def mark_copies(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = 1024) -> DataFrame:
    """``row`` (all columns of ``df`` as a struct), keep_id, group_size, kept, text_sha256 for each row of ``df``.

    Texts are equal when they are the same bytes after each run of blanks became one space; null counts as empty. The
    row with the smallest doc_id of its group stays. Of rows that repeat that doc_id and text exactly one stays. A
    null doc_id counts as larger than any other; if a whole group has none, keep_id is null and one row stays. Columns of
    ``df`` stay inside ``row``, so their names can't clash. An empty table gives an empty result.
    """
    own = numbered(df)
    rows = own.select(F.col(RID).alias("rid"), F.struct(*[f"`{name}`" for name in df.columns]).alias("row"))
    return rows.join(verdicts(own, doc_id, text, bucket_rows), "rid").drop("rid")


def drop_copies(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = 1024) -> DataFrame:
    """The rows of ``df`` that stay, with its columns; nulls, empty texts, ties and repeats as in ``mark_copies``.

    Verdicts are found without the rows, which move once. Very long texts are compared whole; an empty table stays empty.
    """
    own = numbered(df)
    dropped = verdicts(own, doc_id, text, bucket_rows).where(~F.col("kept")).select(F.col("rid").alias(RID))
    return own.join(dropped, RID, "left_anti").select(*[f"`{name}`" for name in df.columns])
