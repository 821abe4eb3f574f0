"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks. DataFrame functions only.

Each source's documents are laid end to end in seeded order and cut into blocks of equal words. The schedule's slots
are van der Corput points: slot i reads the bits of i backwards, which gives each source exactly its number of slots,
spread evenly over the schedule. Slots are ranked per source, and the r-th slot of a source takes its block r modulo
its number of blocks. Orders, sums and ranks are made in many small parts with offsets between them, so a source that
holds a third of all rows is no one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chordgrid.llm.common import BLANKS, RID, is_table, numbered, own_name, shuffle_partitions, stored

#: Rows of a part in which a source's line, and the schedule, are summed; there are at least PARTS parts.
PART_ROWS, PARTS = 50_000, 1024


def _earlier(value: str, *by: str, within: list[str] | None = None) -> Column:
    window = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window.partitionBy(*within) if within else window), F.lit(0))


def targets(base: DataFrame, weights: tuple[int, ...], share: float, most: float, block: int) -> DataFrame:
    """(sid, source, source_size, target, width, blocks, slots, first_slot) for each source.

    A block has ``block`` words, in a small source a sixty-fourth of it, so that whole blocks come near the target.

    Targets divide ``share`` of all words by weight, and none exceeds ``most`` times its source: what lies above is
    given to the others by weight. With sources in the order of their limits, that is one level found in one pass.
    """
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sums = sums.withColumn("sid", order).withColumn("weight", F.element_at(cycle, (F.col("sid") % len(weights) + 1).cast("int")))
    sums = sums.withColumn("limit", F.col("source_size") * most).withColumn("ratio", F.col("limit") / F.col("weight"))
    everything = Window.partitionBy()
    rest = F.sum("weight").over(Window.orderBy("ratio", "sid").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * min(share, most) - _earlier("limit", "ratio", "sid")) / rest
    sums = sums.withColumn("level", level)
    found = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    sums = sums.withColumn("target", F.least(F.coalesce(F.col("weight") * found, F.col("limit")), F.col("limit")))
    sums = sums.withColumn("width", F.greatest(F.lit(1), F.least(F.lit(block), F.expr("source_size div 64"))).cast("long"))
    sums = sums.withColumn("blocks", F.ceil(F.col("source_size") / F.col("width")))
    sums = sums.withColumn("slots", F.least(F.round(F.col("target") / F.col("width")).cast("long"), (F.col("blocks") * most).cast("long")))
    return sums.withColumn("first_slot", _earlier("slots", "sid")).drop("weight", "limit", "ratio", "level")


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, sid, block, pass): the order in which the mix takes blocks; the pass counts a source's rounds through its blocks."""
    spark = sources.sparkSession
    n = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    bits, parts = max(1, n.bit_length()), max(PARTS, n // PART_ROWS)
    width = max(1, -(-n // parts))
    spans = sources.where("slots > 0").select(
        "sid", "blocks", "first_slot", (F.col("first_slot") + F.col("slots")).alias("end_slot")
    )
    spans = spans.select("*", F.explode(F.expr(f"sequence(first_slot div {width}, (end_slot - 1) div {width})")).alias("cell"))
    points = spark.range(n).select(F.col("id").alias("point"), F.expr(f"id div {width}").alias("cell"))
    slots = points.join(spans, (points.cell == spans.cell) & (F.col("point") >= F.col("first_slot")) & (F.col("point") < F.col("end_slot")))
    backwards = F.conv(F.reverse(F.lpad(F.bin("point"), bits, "0")), 2, 10).cast("long")
    slots = slots.select("sid", "blocks", backwards.alias("slot"))
    slots = slots.withColumn("part", F.expr(f"slot div {max(1, (1 << bits) // parts)}"))
    counts = slots.groupBy("sid", "part").agg(F.count("*").alias("n"))
    counts = counts.select("sid", "part", _earlier("n", "part", within=["sid"]).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("sid", "part").orderBy("slot")) - 1 + F.col("offset")
    ranked = slots.join(counts, ["sid", "part"]).withColumn("rank", rank)
    return ranked.select("slot", "sid", (F.col("rank") % F.col("blocks")).alias("block"), F.expr("rank div blocks").alias("pass"))


def lines(base: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document with its place ``start`` on the line of its source, in seeded order."""
    ids = sources.select(F.col("source").alias("named"), "sid", "source_size", "target", "width")
    bits = (max(PARTS, base.count() // PART_ROWS) - 1).bit_length()
    own = base.join(ids, base.source.eqNullSafe(F.col("named"))).drop("named")
    own = own.withColumn("part", F.shiftrightunsigned("key", 64 - bits))
    parts = own.groupBy("sid", "part").agg(F.sum("size").alias("words"))
    parts = parts.select("sid", "part", _earlier("words", "part", within=["sid"]).alias("offset"))
    own = own.withColumn("inner", _earlier("size", "key", "tie", "rid", within=["sid", "part"]))
    return own.join(parts, ["sid", "part"]).withColumn("start", F.col("offset") + F.col("inner"))


def mix(
    df: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    size: Column,
    carry: list[str],
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 128,
    seed: int = 11,
) -> tuple[DataFrame, DataFrame]:
    """The documents (rid, row, size, source_size, target), and what the mix takes of them (rid, pass, slot, from, to).

    ``row`` is a struct of the columns ``carry``, so their names can't clash. ``size`` is in words. A taken piece is
    the words ``from`` to ``to`` (exclusive) of a document in one pass over its source; passes count from 0. It stands in
    the mix at the ``slot`` of its first block. Sources
    are ordered by code point with null last. A null or empty text has size 0 and is never taken; an empty table gives
    empty results; repeated rows and ties are documents of their own. The order depends on ids, sizes and texts only, so
    reruns agree.
    """
    base = stored(
        numbered(df).select(
            F.col(RID).alias("rid"),
            F.struct(*carry).alias("row"),
            F.col(source).cast("string").alias("source"),
            size.cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col(doc_id).cast("long")).alias("key"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("tie"),
        ),
        "mix-documents",
    )
    sources = stored(targets(base, weights, share, most, block), "mix-sources")
    documents = lines(base, sources)
    spans = documents.where("size > 0").select("rid", "sid", "start", "size", "width", F.explode(F.expr("sequence(start div width, (start + size - 1) div width)")).alias("block"))
    met = spans.join(schedule(sources), ["sid", "block"])
    first = F.greatest(F.lit(0), F.col("block") * F.col("width") - F.col("start"))
    last = F.least(F.col("size"), (F.col("block") + 1) * F.col("width") - F.col("start"))
    taken = met.groupBy("rid", "pass").agg(F.min("slot").alias("slot"), F.min(first).alias("from"), F.max(last).alias("to"))
    return documents.select("rid", "row", "size", "source_size", "target"), stored(taken, "mix-pieces")


def taken_words(documents: DataFrame, taken: DataFrame) -> DataFrame:
    """Each document with ``taken``, the words that the mix takes of it, repeats counted, and ``first_slot``, null if none."""
    words = taken.groupBy("rid").agg(F.sum(F.col("to") - F.col("from")).alias("words"), F.min("slot").alias("first_slot"))
    return documents.join(words, "rid", "left").withColumn("taken", F.coalesce("words", F.lit(0)).cast("long")).drop("words")


def mixed_rows(df: DataFrame, documents: DataFrame, taken: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The mix as rows of ``df`` in the order of its slots: one for each document and pass, its text cut to the words taken.

    A document taken whole keeps its text as it is; of a part the words are joined by single spaces, and ``n_chars``,
    where ``df`` has it, counts the new text. Only here do texts move, met by their rows' numbers: ``df`` is
    the table that was mixed, or what ``numbered`` returned and was mixed. Partition by partition, rows follow the schedule.
    Null, empty and blank texts are never taken; repeated rows come as often as they are; an empty table gives an empty mix.
    """
    if RID not in df.columns and not is_table(df):
        raise ValueError("rows that are not a table must be numbered before they are mixed")
    pieces = taken.join(documents.select("rid", "size"), "rid")
    slot, first, end, size, piece = (own_name(name) for name in ("slot", "from", "to", "size", "piece"))
    pieces = pieces.select(F.col("rid").alias(RID), F.col("slot").alias(slot), F.col("from").alias(first), F.col("to").alias(end), F.col("size").alias(size))
    met = numbered(df).join(pieces, RID)
    words = F.filter(F.split(f"`{text}`", BLANKS), lambda w: w != "")
    part = F.array_join(F.slice(words, (F.col(first) + 1).cast("int"), (F.col(end) - F.col(first)).cast("int")), " ")
    whole = (F.col(first) == 0) & (F.col(end) == F.col(size))
    met = met.withColumn(piece, F.when(whole, F.col(f"`{text}`")).otherwise(part))
    columns = {name: F.col(f"`{name}`") for name in df.columns if name != RID}
    columns[text] = F.col(piece)
    if n_chars in columns:
        columns[n_chars] = F.when(whole, columns[n_chars]).otherwise(F.length(piece).cast("long"))
    parts, last = shuffle_partitions(df.sparkSession), taken.agg(F.max("slot")).first()[0] or 0
    ordered = met.select(*[column.alias(name) for name, column in columns.items()], slot)
    part = F.floor(F.col(slot) * parts / (last + 1)).cast("int")
    return ordered.repartitionById(parts, part).sortWithinPartitions(slot).drop(slot)
