"""The tree of merged strings against a plain version, and neighbours that leave related ones out."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import functions as F

from chordgrid.operators import strings
from chordgrid.operators.neighbours import EIGHT, neighbours
from chordgrid.sources.shapes import shape_points


def started(spark, names=("topbar", "tetris")):
    found = None
    for i, name in enumerate(names):
        points = shape_points(spark, name).select(F.lit(i).cast("long").alias("imgid"), (F.col("oid") + 1024 * i).alias("oid"), "y", "x")
        found = points if found is None else found.unionByName(points)
    lit = found.withColumns({"n_y": F.cos("oid"), "n_x": F.sin("oid")})
    return strings.initial_strings(lit, neighbours(lit, EIGHT))


def plain(rows, radii):
    """Rows (imgid, sid, round, a, b, ends, normal, dev, ancestors), every pair looked at."""
    tree = [dict(imgid=r.imgid, sid=n, round=0, a=None, b=None, ends=((r.lf_y, r.lf_x), (r.rt_y, r.rt_x)), n=(r.n_y, r.n_x), dev=0.0, old=frozenset()) for n, r in enumerate(sorted(rows, key=lambda r: (r.imgid, r.sid)))]
    for i, radius in enumerate(radii, 1):
        new = []
        ends = [(s, side) for s in tree for side in (0, 1)]
        for x, (a, p) in enumerate(ends):
            for b, q in ends[x + 1 :]:
                if a["imgid"] != b["imgid"] or math.dist(a["ends"][p], b["ends"][q]) > radius:
                    continue
                if a is b or a["old"] & b["old"] or a["sid"] in b["old"] or b["sid"] in a["old"]:
                    continue
                far = (a["ends"][q], b["ends"][p])
                length = math.dist(*far)
                if length <= 1e-3:
                    continue
                t = [(u + v) / 2 for u, v in zip(a["ends"][p], b["ends"][q])]
                area = (far[1][1] - far[0][1]) * (far[0][0] - t[0]) - (far[0][1] - t[1]) * (far[1][0] - far[0][0])
                n = [(u + v) / 2 for u, v in zip(a["n"], b["n"])]
                size = math.hypot(*n)
                new.append(((a["imgid"], a["sid"], p, b["sid"], q), dict(imgid=a["imgid"], round=i, a=a["sid"], b=b["sid"], ends=far, n=[u / size for u in n], dev=area / length**2, old=a["old"] | b["old"] | {a["sid"], b["sid"]})))
        for _, s in sorted(new, key=lambda pair: pair[0]):
            tree.append(s | {"sid": len(tree)})
    return tree


def test_three_rounds_equal_a_plain_tree(spark):
    whole = started(spark)
    few = [r for i in (0, 1) for r in sorted((r for r in whole.collect() if r.imgid == i), key=lambda r: r.sid)[:5]]
    first = spark.createDataFrame(few, whole.schema)
    got = {r.sid: r for r in strings.merge_forest(first).collect()}
    want = plain(first.collect(), (0.5, 1.0, 1.5))
    assert len(got) == len(want) and {r.round for r in got.values()} == {0, 1, 2, 3}
    for s in want:
        r = got[s["sid"]]
        assert (r.imgid, r.round, r.a_sid, r.b_sid, ((r.lf_y, r.lf_x), (r.rt_y, r.rt_x)), frozenset(r.ancestors)) == (s["imgid"], s["round"], s["a"], s["b"], s["ends"], s["old"])
        assert len(r.ancestors) == len(s["old"]) and all(abs(x - y) < 1e-9 for x, y in zip((r.n_y, r.n_x, r.dev), (*s["n"], s["dev"])))


def test_tree_neighbours_are_all_neighbours_but_the_related(spark):
    tree = strings.grown(strings.string_tree(started(spark)), 0.5).cache()
    ends = strings.string_ends(tree, ("family", "mark"))
    pruned = {(r.lf, r.rt) for r in neighbours(ends, EIGHT, tree=True).collect()}
    family = {r.sid: set(r.family) for r in tree.collect()}
    near = {(r.lf, r.rt) for r in neighbours(ends, EIGHT).collect()}
    assert pruned == {(a, b) for a, b in near if not family[a // 2] & family[b // 2]} and pruned < near


def test_both_rounds_keep_scored_strings(spark):
    """merge_rounds against the same steps by hand, each pair looked at."""
    first = started(spark)
    rows = [(r.imgid, ((r.lf_y, r.lf_x), (r.rt_y, r.rt_x)), (r.n_y, r.n_x), 0.0, r.sid) for r in first.collect()]
    for radius in (1.0, 2.0):
        ends = sorted(((s, side) for s in rows for side in (0, 1)), key=lambda e: f"{e[0][4]}/{e[1]}")
        new = []
        for x, (a, p) in enumerate(ends):
            for b, q in ends[x + 1 :]:
                if a[0] != b[0] or math.dist(a[1][p], b[1][q]) > radius:
                    continue
                lf, rt = a[1][q], b[1][p]
                length = math.dist(lf, rt)
                if length <= 0.1:
                    continue
                t = [(u + v) / 2 for u, v in zip(a[1][p], b[1][q])]
                dev = ((rt[1] - lf[1]) * (lf[0] - t[0]) - (lf[1] - t[1]) * (rt[0] - lf[0])) / length
                m = [(u + v) / 2 for u, v in zip(a[2], b[2])]
                c = ((rt[1] - lf[1]) / length, -(rt[0] - lf[0]) / length)
                size = math.hypot(*m)
                keep = 1 if size > 0 and math.dist([u / size for u in m], c) < math.sqrt(2) else -1
                if b[3] + 1e-3 == 0:
                    continue
                score = a[3] / (b[3] + 1e-3) + math.dist(*a[1]) / (math.dist(*b[1]) + 1e-3) + math.dist(a[2], b[2])
                if score > 1:
                    name = hashlib.md5(f"{a[4]}|{p}|{b[4]}|{q}".encode()).hexdigest()
                    new.append((a[0], (lf, rt), (keep * c[0], keep * c[1]), dev, name))
        rows = new
    got = strings.merge_rounds(first).collect()
    fine = lambda *numbers: tuple(round(n, 6) + 0.0 for n in numbers)
    assert rows and sorted((r.imgid, r.sid, *fine(r.lf_y, r.lf_x, r.rt_y, r.rt_x, r.n_y, r.n_x, r.dev)) for r in got) == sorted((i, name, *fine(*lf, *rt, *n, d)) for i, (lf, rt), n, d, name in rows)
