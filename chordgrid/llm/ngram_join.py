"""N-gram Jaccard join: which documents' sets of word shingles overlap by 90 of 100 or another share, and the groups that links make.

Every link between sets of different groups is found. Equal sets are one node. The index is an R-tree over count
vectors in places: two linked sets differ in few shingles, so when shingles are hashed into one group more than that, the
sets agree on a whole group, and each group's content names a place of the index where both lie. Places with the same
sets are one. Where a place has sets of different components, its tree gives each of them the partners with the best
bounds on overlap; those pairs are verified on the shingles themselves, verified ones join components, and the search
goes on among what is still apart: first with each set at its largest place only, then at all places, each pair at the
first of those it shares, until no bound leaves a pair that wasn't verified.
"""

from __future__ import annotations

import itertools
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chordgrid.llm.batches import lean, whole
from chordgrid.llm.common import RID, numbered, shuffle_partitions, stored, text_of
from chordgrid.llm.count_tree import FAN, STEP, CountTree, enough, overlaps
from chordgrid.llm.shingles import WordHashes, mixed
from chordgrid.operators.components import roots as least_members
from chordgrid.operators.storage import discarded, shuffles_dropped, stored_at

#: Sets at one place that one task searches; a larger place is dealt into blocks.
PLACE = 4096
#: Searches that each set takes part in at one place only, at most; then all places that are still apart are searched whole.
SINGLE_SEARCHES = 2
#: Rows of whole places that are searched at a time.
ROWS_AT_A_TIME = 16_384
#: Rows of a place beyond which it is not named by its sets, so that no task holds it whole.
NAMED_ROWS = 1 << 20
#: Candidate sets whose texts are found by a broadcast of their row numbers (16 bytes each); more are joined.
BROADCAST_ROWS = 2_000_000


def _classes() -> list[int]:
    """The least sizes of the size classes, each half as large again as the one before."""
    bounds = [1, 10]
    while bounds[-1] < 1 << 40:
        bounds.append(bounds[-1] * 3 // 2)
    return bounds


CLASSES = _classes()


def _groups(level: int, similarity: int) -> tuple[int, int]:
    """The number of groups of a size class, and how many of them linked sets may differ on.

    Groups beyond the least number are for those that stay empty: sets with fewer empty groups than those that must agree
    need no signature for them, as they also agree on a filled one with each linked set.
    """
    differ = 2 * (CLASSES[level + 1] - 1) * (100 - similarity) // (100 + similarity)
    empty = (differ + 1) * math.exp(-similarity / 100 * CLASSES[level] / (differ + 1))
    return differ + 3 + int(empty + 2 * math.sqrt(empty)), differ


def signatures(shingles: np.ndarray, similarity: int = 90) -> np.ndarray:
    """Signatures of a set: those of its class, and of the next ones if a linked set may lie there."""
    size = len(shingles)
    own = bisect_right(CLASSES, size) - 1
    out = []
    for level in range(own, len(CLASSES) - 1):
        if level > own and 100 * size < similarity * CLASSES[level]:
            break
        groups, differ = _groups(level, similarity)
        if not differ:  # sets this small are linked only if equal
            continue
        n = np.uint64(groups)
        group = ((shingles >> np.uint64(24)) % n).astype(np.int64)
        content = np.zeros(int(n), np.uint64)
        np.add.at(content, group, shingles)
        names = mixed(content + np.arange(int(n), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level << 48))
        filled = np.bincount(group, minlength=int(n)) > 0
        out.append(names[filled] if (~filled).sum() < groups - differ else names)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def point(shingles: np.ndarray) -> np.ndarray:
    """The counts of a set's groups as bytes: half as many as shingles or up to all, a power of two, more if one overflows.

    With fewer groups the bound would let sets meet that share a long passage and little else, as many as there are pairs.
    """
    groups = max(16, 1 << max(0, (len(shingles) // 2 - 1).bit_length()))
    while True:
        counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if counts.max(initial=0) < 256:
            return counts.astype(np.uint8)
        groups *= 2


ROWS = "rid long, doc_id long, n_shingles long, node long, check long, point binary, signatures array<long>"


def shingled(df: DataFrame, doc_id: str, text: str, width: int, similarity: int) -> DataFrame:
    """Each row's set: its size, two hashes of the whole set (null for none), and, once a task, point and signatures."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        names = [field.split()[0] for field in ROWS.split(", ")]
        for batch in batches:
            sizes, nodes, checks, places, signs = [], [], [], [], []
            for value in batch.column(2):
                shingles = hashes.shingles(value.as_py(), width)
                sizes.append(len(shingles))
                if not len(shingles):
                    nodes.append(None), checks.append(None), places.append(None), signs.append(None)
                    continue
                order = np.arange(1, len(shingles) + 1, dtype=np.uint64)
                both = np.stack((mixed(shingles + order).sum(dtype=np.uint64), mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                node, check = mixed(both + np.uint64(len(shingles))).astype(np.int64).tolist()
                nodes.append(node), checks.append(check)
                first = (node, check) not in seen
                seen.add((node, check))
                places.append(point(shingles).tobytes() if first else None)
                signs.append(signatures(shingles, similarity).astype(np.int64) if first else None)
            columns = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(places, pa.binary()), pa.array(signs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    source = df.select(F.col(RID).alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("text"))
    return source.mapInArrow(run, ROWS)


def told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` with nodes that are equal only for sets of equal 128 bits: where one hash meets two others, both name the node."""
    clashes = rows.where("node is not null").groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo != hi")
    clashes = stored(clashes.select("node", F.lit(True).alias("clash")), "ngram-clashes")
    node = F.when(F.col("clash"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return rows.join(clashes, "node", "left").withColumn("node", node).drop("clash", "check")


def meetings(rows: DataFrame) -> DataFrame:
    """(place, node): where at least two different sets share a signature. Places with the same sets have the same name."""

    @lean
    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        goes_on = None
        for table, ended in whole(batches, ("signature",), ROWS_AT_A_TIME, NAMED_ROWS):
            signature, node = (table.column(i).to_numpy() for i in (0, 1))
            fresh = np.ones(len(node), bool)
            fresh[1:] = (signature[1:] != signature[:-1]) | (node[1:] != node[:-1])
            signature, node = signature[fresh], node[fresh]
            start = np.flatnonzero(np.concatenate(([True], signature[1:] != signature[:-1])))
            sizes = np.diff(np.append(start, len(signature)))
            names = mixed(np.add.reduceat(mixed(node.view(np.uint64)), start) + sizes.astype(np.uint64)).view(np.int64)
            if signature[0] == goes_on or not ended:  # parts of one place keep its signature as their name
                names[0], sizes[0] = signature[0], 2
            goes_on = None if ended else signature[0]
            counts = np.diff(np.append(start, len(signature)))
            many = np.repeat(sizes, counts) > 1
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, counts)[many]), pa.array(node[many])], names=["place", "node"])

    exploded = rows.where("signatures is not null").select(F.explode("signatures").alias("signature"), "node")
    dealt = exploded.repartition(shuffle_partitions(rows.sparkSession), "signature").sortWithinPartitions("signature", "node")
    return dealt.mapInArrow(shared, "place long, node long").distinct()


def _folded(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Points with ``width`` coordinates each: a finer one's coordinates add up to them."""
    values = column.combine_chunks()
    lengths = pc.binary_length(values).to_numpy()
    data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), b"")[0].as_buffer(), np.uint8)
    start = np.cumsum(lengths) - lengths
    out = np.empty((len(values), width), np.uint16)
    for length in np.unique(lengths):
        of = np.flatnonzero(lengths == length)
        out[of] = data[start[of][:, None] + np.arange(length)].reshape(len(of), -1, width).sum(axis=1, dtype=np.uint16)
    return out


def _in_boxes(points: np.ndarray, sizes: np.ndarray, count: np.ndarray, similarity: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, overlap) within places of one box each, that follow each other in ``points``."""
    at = np.arange(len(points))
    after = np.repeat(np.cumsum(count), count) - 1 - at
    i = np.repeat(at, after)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
    overlap = overlaps(points, i, j)
    keep = enough(overlap, sizes[i] + sizes[j], similarity)
    i, j, overlap = i[keep], j[keep], overlap[keep]
    yield np.append(i, j), np.append(j, i), np.append(overlap, overlap)


def _listed(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a column of lists; null is none."""
    lists = column.combine_chunks()
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), pc.list_flatten(lists).to_numpy(zero_copy_only=False)


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in ``ordered``."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class _Failed:
    """The pairs of a table's sets that failed before."""

    def __init__(self, node: np.ndarray, failed: pa.ChunkedArray) -> None:
        self.nodes, self.code = np.unique(node, return_inverse=True)
        row, other = _listed(failed)
        here = _within(other, self.nodes)
        self.keys = np.unique(self.code[row[here]] * len(self.nodes) + np.searchsorted(self.nodes, other[here]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return _within(self.code[i] * len(self.nodes) + self.code[j], self.keys)


class _MetBefore:
    """Whether two rows of a place share a place of a smaller name, which is where they are compared."""

    def __init__(self, place: np.ndarray, start: np.ndarray, places: pa.ChunkedArray) -> None:
        row, other = _listed(places)
        earlier = other < place[row]
        row, other = row[earlier], other[earlier]
        at = np.searchsorted(start, row, side="right")
        order = np.lexsort((other, at))
        row, other, at = row[order], other[order], at[order]
        ends = np.append(np.flatnonzero((other[1:] != other[:-1]) | (at[1:] != at[:-1])) + 1, len(row)) if len(row) else np.zeros(0, np.int64)
        count = np.diff(ends, prepend=0)
        code = np.repeat(np.arange(len(ends)), count)
        shared = np.repeat(count, count) > 1
        row, code = row[shared], code[shared]
        order = np.argsort(row, kind="stable")
        self.codes, self.n = code[order], max(1, len(ends))
        self.length = np.bincount(row, minlength=len(place))
        self.start = np.cumsum(self.length) - self.length
        self.keys = np.sort(row * self.n + code)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        i, j = np.where(self.length[i] <= self.length[j], i, j), np.where(self.length[i] <= self.length[j], j, i)
        done = np.cumsum(self.length[i])
        first = 0
        while first < len(i):
            last = max(first + 1, int(np.searchsorted(done, (done[first - 1] if first else 0) + STEP, side="right")))
            count = self.length[i[first:last]]
            pair = np.repeat(np.arange(first, last), count)
            at = np.repeat(self.start[i[first:last]] - np.cumsum(count) + count, count) + np.arange(count.sum())
            out[pair[_within(j[pair] * self.n + self.codes[at], self.keys)]] = True
            first = last
        return out


def best_partners(table: pa.Table, similarity: int, most: int) -> np.ndarray:
    """(place, a, b) with a < b: for each row its ``most`` partners by bound among sets of other components at its place.

    ``table`` holds whole places (place, x, y, block, node, root, n_shingles, point, failed), sorted by place and blocks.
    With x < y sets of block x meet those of block y. Pairs that failed before are left out, and with a column ``places``,
    all places of each set, those that share a place of a smaller name.
    """
    column = {name: table.column(name).to_numpy() for name in ("place", "x", "y", "block", "node", "root", "n_shingles")}
    node, root, sizes = column["node"], column["root"], column["n_shingles"]
    fresh = np.ones(len(node), bool)
    fresh[1:] = np.any([column[c][1:] != column[c][:-1] for c in ("place", "x", "y")], axis=0)
    start = np.flatnonzero(fresh)
    count = np.diff(np.append(start, len(node)))
    width = np.minimum.reduceat(pc.binary_length(table.column("point")).to_numpy(), start)
    before = [_Failed(node, table.column("failed"))]
    if "places" in table.column_names:
        before.append(_MetBefore(column["place"], start, table.column("places")))
    out = []

    def kept(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        for i, j, overlap in found:
            new = root[i] != root[j]
            i, j, overlap = i[new], j[new], overlap[new]
            for known in before:
                new = ~known(i, j)
                i, j, overlap = i[new], j[new], overlap[new]
            if not len(i):
                continue
            order = np.lexsort((node[j], -overlap / (sizes[i] + sizes[j]), i))
            i, j = i[order], j[order]
            first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
            rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
            i, j = i[rank < most], j[rank < most]
            out.append(np.stack((column["place"][i], np.minimum(node[i], node[j]), np.maximum(node[i], node[j])), axis=1))

    one_block = column["x"][start] == column["y"][start]
    for w in np.unique(width):
        small = np.flatnonzero((width == w) & (count <= FAN) & (count > 1) & one_block)
        if len(small):
            skipped = np.cumsum(count[small]) - count[small]
            rows = np.repeat(start[small] - skipped, count[small]) + np.arange(count[small].sum())
            points = _folded(table.column("point").take(pa.array(rows)), int(w))
            kept((rows[i], rows[j], overlap) for i, j, overlap in _in_boxes(points, sizes[rows], count[small], similarity))
    for p in np.flatnonzero((count > FAN) | ~one_block):
        rows = np.arange(start[p], start[p] + count[p])
        points = _folded(table.column("point").slice(start[p], count[p]), int(width[p]))
        left, right = (rows[column["block"][rows] == column[c][start[p]]] for c in "xy")
        if not len(left) or not len(right):
            continue
        tree = CountTree(points[left - start[p]], sizes[left])
        other = tree if one_block[p] else CountTree(points[right - start[p]], sizes[right])
        kept((left[i], right[j], overlap) for i, j, overlap in tree.pairs(other, similarity))
        if other is not tree:
            kept((right[i], left[j], overlap) for i, j, overlap in other.pairs(tree, similarity))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)


def still_apart(met: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(place, node, root, n): the places whose ``n`` sets are of several components; stored."""
    known = met.select("place", "node")
    known = known.withColumn("root", F.col("node")) if roots is None else known.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    at = Window.partitionBy("place")
    known = known.select("place", "node", "root", F.count("*").over(at).alias("n"), F.min("root").over(at).alias("lo"), F.max("root").over(at).alias("hi"))
    return stored(known.where("lo != hi").drop("lo", "hi"), "ngram-apart")


def largest_places(met: DataFrame) -> DataFrame:
    """Each set at the largest of its places only, so that copies by the thousand meet once and not at all places they share."""
    return met.groupBy("node").agg(F.max(F.struct("n", "place", "root")).alias("at")).select("at.place", "node", "at.root", "at.n")


def candidates(members: DataFrame, failed: DataFrame, nodes: DataFrame, similarity: int, most: int, whole_places: bool) -> DataFrame:
    """(place, a, b): what the trees of places give; at most ``most`` partners for each set at a place.

    A place of more than PLACE sets is dealt into blocks; each is searched by itself, or with ``whole_places`` each pair of
    them. With ``whole_places`` a pair is given only at the first of the places of ``members`` that it shares.
    """
    own = ["n_shingles", "point"]
    if whole_places:  # each set's places, and at each of them those of smaller names
        own.append("places")
        members = members.join(members.groupBy("node").agg(F.collect_list("place").alias("places")), "node")
        members = members.withColumn("places", F.filter("places", lambda other: other < F.col("place")))
    members = members.withColumn("blocks", F.ceil(F.col("n") / PLACE).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    members = members.join(nodes.select("node", "n_shingles", "point"), "node")
    members = members.join(failed.groupBy("node").agg(F.collect_list("other").alias("failed")), "node", "left")
    members = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1) if whole_places else F.array("block")))
    members = members.select(
        "place", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "block", "node", "root", *own, "failed"
    )

    @lean
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole(batches, ("place", "x", "y"), ROWS_AT_A_TIME):
            found = best_partners(table.combine_chunks(), similarity, most)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(3)], names=["place", "a", "b"])

    dealt = members.repartition(shuffle_partitions(members.sparkSession), "place", "x", "y").sortWithinPartitions("place", "x", "y")
    return dealt.mapInArrow(search, "place long, a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(a, b, linked) of each pair: whether its sets are linked."""

    @lean
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                overlap = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(bool(enough(overlap, len(p) + len(q), similarity)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("p"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("q"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "p", "q").mapInArrow(check, "a long, b long, linked boolean")


def shingle_sets(df: DataFrame, wanted: DataFrame, text: str, width: int) -> DataFrame | None:
    """(node, shingles) of ``wanted`` (node, rid), read again from one text of each; None if none are wanted."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [hashes.shingles(value.as_py(), width).tobytes() for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    wanted = stored(wanted, "ngram-wanted")
    n = wanted.count()
    if not n:
        return None
    texts = df.select(F.col(RID).alias("rid"), text_of(text).cast("binary").alias("text"))
    chosen = F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted
    return stored(texts.join(chosen, "rid").select("node", "text").mapInArrow(run, "node long, shingles binary"), "ngram-sets")


def indexed(df: DataFrame, doc_id: str, text: str, width: int, similarity: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (rid, doc_id, n_shingles, node), what ``meetings`` gives, and the sets that meet (node, rid, n_shingles, point); stored, and without the signatures."""
    wide, path = stored_at(shingled(df, doc_id, text, width, similarity), "ngram-shingled")
    wide = told_apart(wide)
    met = stored(meetings(wide), "ngram-meetings")
    nodes = wide.where("point is not null").groupBy("node").agg(F.min("rid").alias("rid"), F.first("n_shingles").alias("n_shingles"), F.first("point").alias("point"))
    nodes = stored(nodes.join(met.select("node"), "node", "left_semi"), "ngram-nodes")
    rows = stored(wide.select("rid", "doc_id", "n_shingles", "node"), "ngram-rows")
    discarded(df.sparkSession, path)
    return rows, met, nodes


def joined(df: DataFrame, met: DataFrame, nodes: DataFrame, text: str, width: int, similarity: int) -> DataFrame:
    """(node, root) of the nodes that links join to a smaller one."""
    spark = df.sparkSession
    sets, tried = spark.createDataFrame([], "node long, shingles binary"), spark.createDataFrame([], "a long, b long, linked boolean")
    met, roots, whole_places, most = still_apart(met, None), spark.createDataFrame([], "node long, root long"), False, 1
    for search in itertools.count(1):
        failed = tried.where("not linked").select(F.col("a").alias("node"), F.col("b").alias("other"))
        failed = failed.union(failed.select("other", "node"))
        found = candidates(met if whole_places else largest_places(met), failed, nodes, similarity, most, whole_places)
        found = stored(found, "ngram-candidates")
        done = found.isEmpty()
        if not done:
            pairs = found.select("a", "b").distinct()
            new = found.select(F.col("a").alias("node")).union(found.select("b")).distinct().join(sets.select("node"), "node", "left_anti")
            more = shingle_sets(df, nodes.select("node", "rid").join(new, "node"), text, width)
            sets = sets if more is None else sets.unionByName(more)
            checked = stored(verified(pairs, sets, similarity), "ngram-verified")
            tried = tried.unionByName(checked)
            if not checked.where("linked").isEmpty():
                roots = least_members(tried.where("linked").select(F.col("a").alias("lf"), F.col("b").alias("rt")))
            if whole_places:  # where nothing is found, nothing will be
                met = met.join(found.select("place").distinct(), "place", "left_semi")
            met = still_apart(met, roots)
        elif whole_places:
            return roots
        whole_places = whole_places or done or search >= SINGLE_SEARCHES
        most = 8 * most if whole_places else most


def near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3, similarity: int = 90) -> DataFrame:
    """rid, doc_id, n_shingles, component_id, first for each row of ``df``.

    Sets of ``width``-word shingles are linked where they share ``similarity`` of 100 of their union or more (1 to 100).
    component_id is the smallest doc_id that links reach; first is true for one row of each component, one with that
    doc_id. rid is the row's number in its table (``numbered``). A null, empty or blank text has no shingles, is linked with nothing and is its own component; texts of
    fewer than ``width`` words are one shingle; very long texts are read whole; repeated rows and equal sets are linked;
    null doc_ids count as larger than any other, and a component of them alone has a null component_id. Other columns are
    not read; an empty table gives an empty result. Sets are identified by a 128-bit hash of all their shingles.
    """
    df = numbered(df)
    with shuffles_dropped(df.sparkSession):
        rows, met, nodes = indexed(df, doc_id, text, width, similarity)
        roots = joined(df, met, nodes, text, width, similarity)
    own = rows.select("rid", "doc_id", "n_shingles", "node").join(roots, "node", "left")
    own = own.withColumn("root", F.coalesce("root", "node"))
    least = own.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    firsts = own.where("root is not null").join(least, "root").where(F.col("doc_id").eqNullSafe(F.col("least")))
    firsts = firsts.groupBy("root").agg(F.min("rid").alias("first_rid"))
    out = own.join(least.join(firsts, "root"), "root", "left")
    alone = F.col("root").isNull()
    return out.select(
        "rid", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        (alone | (F.col("rid") == F.col("first_rid"))).alias("first"),
    )


def drop_near_duplicates(df: DataFrame, **options) -> DataFrame:
    """One row of each component, with the columns of ``df``."""
    own = numbered(df)
    kept = near_duplicates(own, **options).where("first").select(F.col("rid").alias(RID))
    return own.join(kept, RID).select(*[f"`{name}`" for name in df.columns])
