"""Batches of many small components in the forest of disjoint sets."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from chordgrid.operators import unionfind
from chordgrid.operators.unionfind import UnionFind


def plain(batches):
    """Roots by the weighted rule, link by link."""
    place, parent, size = {}, [], []
    for links in batches:
        for x, y in links:
            for e in (x, y):
                if e not in place:
                    place[e] = len(parent)
                    parent.append(len(parent))
                    size.append(1)
            a, b = place[x], place[y]
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b:
                low, high = (a, b) if size[a] < size[b] else (b, a)
                parent[low] = high
                size[high] += size[low]

    def top(n):
        return n if parent[n] == n else top(parent[n])

    return {(x, n, top(n)) for x, n in place.items()}


def test_small_components_are_replayed_together(spark, monkeypatch):
    chance = random.Random(3)
    batches = [[(chance.randrange(900), chance.randrange(900)) for _ in range(250)] for _ in range(2)]
    calls, run = spark.sparkContext.accumulator(0), unionfind._replayed

    def counted(key, links):
        calls.add(1)
        return run(key, links)

    monkeypatch.setattr(unionfind, "_replayed", counted)
    monkeypatch.setattr(unionfind, "BLOCK", 100, raising=False)
    forest = UnionFind.of(spark)
    for links in batches:
        forest = forest.union(spark.createDataFrame([(x, y, i) for i, (x, y) in enumerate(links)], "x long, y long, order long"))
    assert {(r.x, r.idx, r.root) for r in forest.labelled().collect()} == plain(batches)
    assert forest.labelled().groupBy("root").count().where(F.col("count") > 1).count() > 20
    assert 2 <= calls.value <= 6  # at most three blocks of a batch
