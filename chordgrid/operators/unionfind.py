"""A disjoint-set forest as tables: elements (x, idx) in order of insertion, and versions of who belongs to which root.

A batch of links is contracted to the roots of the sets that it touches, replayed in order on these alone, and stored as one more
version; nothing else is touched. Of two sets the larger one's root stays, of equals the root of a link's first element.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chordgrid.operators.components import roots
from chordgrid.operators.storage import stored
from chordgrid.sources.loader import numbered

#: Versions that lookups go through before they are made one.
VERSIONS = 6
#: Links of small components that are replayed together.
BLOCK = 100_000
_VERSION = "idx long, root long, size long"


def _replayed(_key: tuple, links: pd.DataFrame) -> pd.DataFrame:
    """Whole components' links in their order; links of different components don't meet, so it is the order in each."""
    links = links.sort_values(["order", "x", "y"])
    nodes, place = np.unique(np.concatenate([links.rx.to_numpy(), links.ry.to_numpy()]), return_inverse=True)
    given = np.zeros(len(nodes), np.int64)
    given[place] = np.concatenate([links.sx.to_numpy(), links.sy.to_numpy()])
    size, parent = given.tolist(), list(range(len(nodes)))

    def top(node: int) -> int:
        while parent[node] != node:
            parent[node] = parent[parent[node]]
            node = parent[node]
        return node

    for x, y in zip(place[: len(links)].tolist(), place[len(links) :].tolist()):
        x, y = top(x), top(y)
        if x != y:
            low, high = (x, y) if size[x] < size[y] else (y, x)
            parent[low] = high
            size[high] += size[low]
    tops = np.array([top(node) for node in range(len(nodes))], np.int64)
    return pd.DataFrame({"idx": nodes, "root": nodes[tops], "size": np.array(size, np.int64)[tops]})


def _in_rounds(links: DataFrame) -> DataFrame:
    """Links of components of any size: a link that is the first of all at both its sets is next for them, whatever others do."""
    ends = [links.select(F.col(f"r{c}").alias("idx"), F.col(f"s{c}").alias("size")) for c in "xy"]
    nodes = stored(ends[0].union(ends[1]).distinct().select("idx", F.col("idx").alias("root"), "size"), "forest-nodes")
    links = links.select("rx", "ry", F.struct("order", "x", "y").alias("key"))
    while not links.isEmpty():
        ends = links.select(F.col("rx").alias("root"), "key").union(links.select("ry", "key"))
        first = ends.groupBy("root").agg(F.min("key").alias("first"))
        for c in "xy":
            links = links.join(first.select(F.col("root").alias(f"r{c}"), F.col("first").alias(f"first_{c}")), f"r{c}")
        chosen = links.where((F.col("key") == F.col("first_x")) & (F.col("key") == F.col("first_y")))
        sizes = nodes.where("idx = root").select("root", "size")
        for c in "xy":
            chosen = chosen.join(sizes.select(F.col("root").alias(f"r{c}"), F.col("size").alias(f"s{c}")), f"r{c}")
        x_stays = F.col("sx") >= F.col("sy")
        stays = F.when(x_stays, F.col("rx")).otherwise(F.col("ry"))
        moved = stored(chosen.select(F.explode(F.array("rx", "ry")).alias("root"), stays.alias("to"), (F.col("sx") + F.col("sy")).alias("total")), "forest-moves")
        nodes = stored(nodes.join(moved, "root", "left").select("idx", F.coalesce("to", "root").alias("root"), F.coalesce("total", "size").alias("size")), "forest-nodes")
        for c in "xy":
            links = links.join(moved.select(F.col("root").alias(f"r{c}"), F.col("to").alias(f"to_{c}")), f"r{c}", "left").withColumn(f"r{c}", F.coalesce(f"to_{c}", f"r{c}"))
        links = stored(links.where("rx != ry").select("rx", "ry", "key"), "forest-links")
    return nodes


@dataclass(frozen=True)
class UnionFind:
    """Sets of longs. Each change gives a new forest; the index of an element is its place of insertion.

    Components of a batch with at most ``replay`` links are replayed in tasks, small ones together, larger ones in rounds of joins.
    """

    elements: DataFrame
    versions: tuple[DataFrame, ...] = ()
    replay: int = 1_000_000

    @staticmethod
    def of(spark: SparkSession, elements: list[int] = (), replay: int = 1_000_000) -> UnionFind:
        rows = [(x, i) for i, x in enumerate(dict.fromkeys(elements))]
        return UnionFind(spark.createDataFrame(rows, "x long, idx long"), replay=replay)

    def add(self, new: DataFrame) -> UnionFind:
        """With the elements of ``new`` (x, order) that it lacks, in their order."""
        fresh = stored(new.groupBy("x").agg(F.min("order").alias("order")).join(self.elements, "x", "left_anti"), "forest-fresh")
        if fresh.isEmpty():
            return self
        start = self.n_elts
        placed = stored(numbered(fresh, "order", "x").select("x", (F.col("idx") + start).alias("idx")), "forest-elements")
        return replace(self, elements=self.elements.unionByName(placed))

    def union(self, pairs: DataFrame) -> UnionFind:
        """With the sets of each pair (x, y, order) joined, in order, ties by x and y; unknown elements are added, x before y."""
        both = pairs.select("x", (2 * F.col("order")).alias("order")).unionByName(pairs.select(F.col("y").alias("x"), (2 * F.col("order") + 1).alias("order")))
        grown = self.add(both)
        of = grown._resolved(grown.elements)
        links = pairs.join(of.select("x", F.col("root").alias("rx"), F.col("size").alias("sx")), "x").join(of.select(F.col("x").alias("y"), F.col("root").alias("ry"), F.col("size").alias("sy")), "y")
        links = stored(links.where("rx != ry").select("rx", "ry", "sx", "sy", "order", "x", "y"), "forest-links")
        if links.isEmpty():
            return grown
        label = roots(links.select(F.col("rx").alias("lf"), F.col("ry").alias("rt")))
        blocks = -(-links.count() // BLOCK)
        links = links.join(label.withColumnsRenamed({"node": "rx", "root": "part"}), "rx", "left").withColumn("part", F.coalesce("part", "rx"))
        large = stored(links.groupBy("part").count().where(F.col("count") > grown.replay).select("part"), "forest-large")
        block = F.pmod(F.xxhash64("part"), F.lit(blocks)).alias("block")
        if large.isEmpty():
            version = links.groupBy(block).applyInPandas(_replayed, _VERSION)
        else:
            version = links.join(large, "part", "left_anti").groupBy(block).applyInPandas(_replayed, _VERSION)
            version = version.unionByName(_in_rounds(stored(links.join(large, "part", "left_semi").drop("part"), "forest-links")))
        grown = replace(grown, versions=(*grown.versions, stored(version, "forest-version")))
        return grown if len(grown.versions) < VERSIONS else grown.compacted()

    def compacted(self) -> UnionFind:
        """The same forest with its versions made one."""
        if not self.versions:
            return self
        named = reduce(DataFrame.union, [v.select("idx") for v in self.versions]).distinct()
        return replace(self, versions=(stored(self._resolved(named).select("idx", "root", "size"), "forest-version"),))

    def _resolved(self, table: DataFrame) -> DataFrame:
        """``table`` (idx) with the root and size of each one's set."""
        table = table.withColumn("root", F.col("idx")).withColumn("size", F.lit(1).cast("long"))
        for version in self.versions:
            step = version.select(F.col("idx").alias("root"), F.col("root").alias("to"), F.col("size").alias("grown"))
            kept = [c for c in table.columns if c not in ("root", "size")]
            table = table.join(step, "root", "left").select(*kept, F.coalesce("to", "root").alias("root"), F.coalesce("grown", "size").alias("size"))
        return table

    def labelled(self) -> DataFrame:
        """(x, idx, root): the root is the index of one of the set. Found once for each forest."""
        return self._labels

    @cached_property
    def _labels(self) -> DataFrame:
        return stored(self._resolved(self.elements).select("x", "idx", "root"), "forest")

    def find(self, x: int) -> int:
        row = self.labelled().where(F.col("x") == x).first()
        if row is None:
            raise ValueError(f"{x} is not an element")
        return row.root

    def connected(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (x, y) with whether both are in one set; null where one is unknown."""
        of = self.labelled()
        a, b = of.select("x", F.col("root").alias("rx")), of.select(F.col("x").alias("y"), F.col("root").alias("ry"))
        return pairs.join(a, "x", "left").join(b, "y", "left").select("x", "y", (F.col("rx") == F.col("ry")).alias("connected"))

    def component(self, x: int) -> DataFrame:
        """(x) of the members of an element's set."""
        root = self.find(x)
        return self.labelled().where(F.col("root") == root).select("x")

    def components(self) -> DataFrame:
        """(root, members) of each set."""
        return self.labelled().groupBy("root").agg(F.sort_array(F.collect_set("x")).alias("members"))

    def component_mapping(self) -> DataFrame:
        """(x, members): each element with its set."""
        return self.labelled().join(self.components(), "root").select("x", "members")

    def contains(self, values: DataFrame) -> DataFrame:
        """Those rows of ``values`` (x) that are elements."""
        return values.join(self.elements, "x", "left_semi")

    def at(self, idx: int) -> int:
        row = self.elements.where(F.col("idx") == idx).first()
        if row is None:
            raise IndexError(idx)
        return row.x

    def relabel(self, idx: int, x: int) -> UnionFind:
        """With the element at ``idx`` renamed; its set stays."""
        self.at(idx)
        name: Column = F.when(F.col("idx") == idx, F.lit(x)).otherwise(F.col("x")).alias("x")
        return replace(self, elements=self.elements.select(name, "idx"))

    @property
    def n_elts(self) -> int:
        return self.elements.count()

    @property
    def n_comps(self) -> int:
        return self.labelled().select("root").distinct().count()

    def __len__(self) -> int:
        return self.n_elts

    def __repr__(self) -> str:
        return f"UnionFind(n_elts={self.n_elts}, n_comps={self.n_comps})"
