"""Operators that compare, order or mix documents, against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chordgrid.llm import bwt, exact_dedup, mixing, ngram_join, queries, repeated_spans, sharding, toxicity
from chordgrid.llm.batches import whole
from chordgrid.llm.common import RID, WORD, numbered, text_of
from chordgrid.llm.count_tree import CountTree, enough, overlaps


def key(r):
    return (r.doc_id is None, r.doc_id or 0)


def test_exact_dedup(spark, docs, empty, monkeypatch):
    got = exact_dedup.mark_copies(docs, bucket_rows=4).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()].append(r.doc_id)
    assert Counter(r.text_sha256 for r in got) == Counter({k: len(v) for k, v in groups.items()})
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(dict.fromkeys(groups, 1))
    assert sorted(map(key, exact_dedup.drop_copies(docs).collect())) == sorted(key(r) for r in got if r.kept)
    paged = exact_dedup.mark_copies(docs, bucket_rows=1).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(str, paged)) == sorted(map(str, got))
    monkeypatch.setattr(exact_dedup, "BROADCAST_BITS", 0)
    joined = exact_dedup.mark_copies(docs, bucket_rows=1).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(str, joined)) == sorted(map(str, got))
    assert exact_dedup.drop_copies(docs).columns == docs.columns and exact_dedup.drop_copies(empty).count() == 0


def test_exact_dedup_equals_its_sql(spark):
    assert all(isinstance(sql, str) and name in queries.QUERIES for name, sql in queries.ORACLE_SQL.items())
    sf_dir = "/root/testdata/sf0.001"
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    columns = "doc_id, keep_id, group_size, kept, text_sha256"
    twin = duckdb.execute(f"SELECT {columns} FROM ({queries.ORACLE_SQL['op7_exact_dedup']}) ORDER BY doc_id").fetchall()
    got = queries.op7_exact_dedup(spark, sf_dir).select(columns.split(", ")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == twin


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return set(zip(words, words[1:], words[2:])) if len(words) > 2 else {tuple(words)} if words else set()


def test_ngram_join(spark, docs, empty):
    rng = np.random.default_rng(4)
    pool = [f"w{i}" for i in range(400)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for family in range(12):
        text = list(rng.choice(pool, int(rng.integers(8, 260))))
        for _ in range(8):
            copy = list(text)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 3))):
                copy[at] = str(rng.choice(pool))
            rows.append((100 + len(rows), " ".join(copy)))
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = ngram_join.near_duplicates(table).orderBy("rid").collect()
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 90 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        ids = [d for d in (least.get(find(i)), doc_id) if d is not None]
        least[find(i)] = min(ids) if ids else None
    assert [(r.n_shingles, r.component_id) for r in got] == [(len(s), least[find(i)]) for i, s in enumerate(sets)]
    assert Counter(find(i) for i, r in enumerate(got) if r.first) == Counter({find(i): 1 for i in range(len(rows))})
    assert ngram_join.near_duplicates(empty).count() == 0


def test_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = a[rng.random(len(a)) > rng.choice([0, 0.03, 0.06])]
        b = np.unique(np.append(b, rng.integers(0, 1 << 63, int(rng.integers(0, 2 + n // 20))).astype(np.uint64)))
        linked = len(a) and len(b) and enough(len(np.intersect1d(a, b)), len(a) + len(b))
        if linked and not np.array_equal(a, b):
            assert len(np.intersect1d(ngram_join.signatures(a), ngram_join.signatures(b)))


def test_count_tree_keeps_every_pair_with_enough():
    rng = np.random.default_rng(6)
    points = rng.poisson(2, (150, 8)).astype(np.uint16)
    points[100:] = points[:50] + (rng.random((50, 8)) < 0.1)
    sizes = points.sum(axis=1).astype(np.int64)
    x, y = CountTree(points[:90], sizes[:90]), CountTree(points[90:], sizes[90:])
    want = {(i, j) for i in range(90) for j in range(60) if enough(np.minimum(points[i], points[90 + j]).sum(), sizes[i] + sizes[90 + j])}
    got = [(int(i), int(j), int(n)) for part in x.pairs(y) for i, j, n in zip(*part)]
    assert {(i, j) for i, j, _ in got} == want and len(got) == len(want)
    assert all(n == overlaps(points, np.array([i]), np.array([90 + j]))[0] for i, j, n in got)


def place_rows(rng, place, n, blocks=1):
    """Rows of one place: near-equal sets as points, some of one component."""
    base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    rows = []
    for k in range(n):
        members = np.unique(np.append(base[rng.random(60) > 0.06], rng.integers(0, 1 << 62, int(rng.integers(0, 5))).astype(np.uint64)))
        rows.append({"place": place, "block": k % blocks, "node": 1000 * place + k, "root": 1000 * place + k % max(1, n // 2), "n_shingles": len(members), "point": ngram_join.point(members).tobytes(), "failed": None})
    return rows


def test_best_partners_are_the_best_of_other_components():
    rng = np.random.default_rng(16)
    for n, most in ((2, 1), (7, 1), (16, 3), (40, 1), (90, 5)):
        rows = place_rows(rng, 1, n) + place_rows(rng, 2, 5)
        rows[0]["failed"] = [rows[1]["node"]]
        table = pa.Table.from_pylist([r | {"x": 0, "y": 0} for r in rows], schema=PLACE)
        got = {(a, b) for _, a, b in ngram_join.best_partners(table, 90, most).tolist()}
        assert len(got) <= most * len(rows)
        for r in rows:
            found = []
            for other in rows:
                p, q = (np.frombuffer(x["point"], np.uint8).astype(int) for x in (r, other))
                least = min(len(p), len(q))
                bound = np.minimum(p.reshape(-1, least).sum(axis=0), q.reshape(-1, least).sum(axis=0)).sum()
                sizes = r["n_shingles"] + other["n_shingles"]
                if other["place"] == r["place"] and other["root"] != r["root"] and other["node"] not in (r["failed"] or []) and enough(bound, sizes):
                    found.append((-bound / sizes, other["node"]))
            assert {tuple(sorted((r["node"], node))) for _, node in sorted(found)[:most]} <= got


PLACE = pa.schema([*[(name, pa.int64()) for name in ("place", "x", "y", "block", "node", "root", "n_shingles")], ("point", pa.binary()), ("failed", pa.list_(pa.int64()))])


def test_pairs_are_compared_at_the_first_place_they_share():
    rng = np.random.default_rng(19)
    rows = []
    for place in (1, 2, 3):
        members = place_rows(np.random.default_rng(20), place, 40)
        rows += [r | {"node": k, "root": k, "x": 0, "y": 0} for k, r in enumerate(members)]
    listed = {k: sorted({int(p) for p in rng.integers(1, 4, 2)}) for k in range(40)}
    rows = [r | {"places": listed[r["node"]]} for r in rows if r["place"] in listed[r["node"]]]
    fields = PLACE.append(pa.field("places", pa.list_(pa.int64())))
    got = ngram_join.best_partners(pa.Table.from_pylist(rows, schema=fields), 80, 100).tolist()
    everywhere = ngram_join.best_partners(pa.Table.from_pylist(rows, schema=fields).drop_columns(["places"]), 80, 100).tolist()
    assert sorted(got) == sorted([p, a, b] for p, a, b in everywhere if p == min(set(listed[a]) & set(listed[b])))
    assert {(a, b) for _, a, b in got} == {(a, b) for _, a, b in everywhere} and len(got) < len(everywhere)


def test_blocks_of_a_large_place_meet_each_other():
    rows = place_rows(np.random.default_rng(17), 3, 60, blocks=3)
    table = pa.Table.from_pylist([r | {"x": 0, "y": 2} for r in rows if r["block"] in (0, 2)], schema=PLACE)
    got = ngram_join.best_partners(table, 90, 60).tolist()
    assert got and all({(a - 3000) % 3, (b - 3000) % 3} == {0, 2} for _, a, b in got)


def test_large_places_are_searched_whole(spark, monkeypatch):
    """Blocks and unnamed places, forced by small bounds (workers are forked after the change), lose no link."""
    monkeypatch.setattr(ngram_join, "PLACE", 5)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: i % 50], f"own{i}", *base[i % 50 :]])) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.near_duplicates(table, width=1).collect()
    assert {r.component_id for r in got} == {0}


def test_keys_are_not_cut_between_tables():
    keys = np.sort(np.random.default_rng(18).integers(0, 30, 500))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 37])], names=["k"]) for i in range(0, 500, 37)]
    parts = [(t.column("k").to_pylist(), ended) for t, ended in whole(iter(batches), ("k",), 60)]
    assert sum((p for p, _ in parts), []) == keys.tolist() and all(ended for _, ended in parts)
    assert all(a[0][-1] != b[0][0] for a, b in zip(parts, parts[1:]))
    parts = [(t.num_rows, ended) for t, ended in whole(iter([pa.RecordBatch.from_arrays([pa.array([7] * 90)], names=["k"])] * 3), ("k",), 60, 100)]
    assert sum(n for n, _ in parts) == 270 and not parts[0][1]


def test_equal_hashes_of_different_sets_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 5, 70), (2, 5, 71), (3, 5, 70), (4, 6, 80), (5, None, None)], "rid long, node long, check long")
    got = {r.rid: r.node for r in ngram_join.told_apart(rows).collect()}
    assert got[1] == got[3] != got[2] and got[4] == 6 and got[5] is None and 5 not in got.values()


def test_repeated_spans(spark, docs, empty):
    rows = sorted(docs.collect(), key=lambda r: (key(r), r.text or ""))
    seen, want = set(), []
    for r in rows:
        data = (r.text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(data[i : i + 100])
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want.append((str(r.doc_id), len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = repeated_spans.remove_repeats(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert repeated_spans.remove_repeats(empty).count() == 0


def test_merged_transforms_find_the_repeats():
    rng = np.random.default_rng(7)
    for _ in range(100):
        depth = int(rng.integers(1, 10))
        texts = [np.array([s for _ in range(rng.integers(1, 4)) for s in [*rng.integers(1, 4, rng.integers(1, 20)), 0]], np.uint8) for _ in range(rng.integers(1, 4))]
        orders = [bwt.suffix_order(t, depth) for t in texts]
        at, interval = bwt.merge([bwt.transform(t, o) for t, o in zip(texts, orders)], depth)
        where = [(s, int(i)) for s, o in enumerate(orders) for i in o]
        got, want = defaultdict(list), defaultdict(list)
        for a, v in zip(at, interval):
            got[v].append(where[a])
        for s, t in enumerate(texts):
            for i in range(len(t) - depth + 1):
                if t[i : i + depth].all():
                    want[t[i : i + depth].tobytes()].append((s, i))
        assert sorted(map(sorted, got.values())) == sorted(v for v in want.values() if len(v) > 1)


def test_directory_splits_and_pages(spark):
    """Buckets hold few records; what no doubling parts has pages, so its owners share it."""
    hashes = [(i << 54) for i in range(-500, 500)] + [7] * 300
    records = spark.createDataFrame([(h,) for h in hashes], "h long")
    cells, bits = exact_dedup.directory(records, len(hashes), 40)
    rows = cells.collect()
    loads = Counter()
    of = {r.cell: r for r in rows}
    for h in hashes:
        loads[of[(h % (1 << 64)) >> (64 - bits)].bucket] += 1
    assert all(r.pages == -(-loads[r.bucket] // 40) for r in rows) and max(r.pages for r in rows) > 7
    assert all(n <= 40 for b, n in loads.items() if b != of[0].bucket) and len(loads) > 25


def test_owners_decide_by_their_directory(spark, docs, monkeypatch):
    """Without a bucket for a hash its texts have no owner, and the result would lack them."""
    real = exact_dedup.directory
    monkeypatch.setattr(exact_dedup, "directory", lambda *a: (real(*a)[0].limit(0), real(*a)[1]))
    assert exact_dedup.mark_copies(docs).where("group_size > 1").count() == 0


def test_sharding(spark, docs, empty, tmp_path):
    size = F.octet_length(text_of("text")) + 1
    columns = ("row.doc_id", "size", "row.text", "law", "shard", "slot")
    got = sharding.shard(docs, size, bucket_bytes=5000).select(*columns).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1)] + [(s, 0) for s in range(1, 16)]
    assert {r.law for r in got} == {"rows"} and all(r["size"] == len((r.text or "").encode()) + 1 for r in got)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for partitions, adaptive in (("3", "true"), ("7", "false")):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            again = sharding.shard(docs, size, bucket_bytes=5000).select(*columns).collect()
            assert sorted(map(str, got)) == sorted(map(str, again))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    written = sharding.write_shards(sharding.shard(docs, size, bucket_bytes=5000), str(tmp_path / "shards"))
    assert sorted(map(str, written.select(*columns).collect())) == sorted(map(str, got))
    assert written.select("row.n_tokens", "row.row").distinct().count() == 1
    assert sharding.shard(empty, size).count() == 0 and sharding.write_shards(sharding.shard(empty, size), str(tmp_path / "none")).count() == 0


def test_queries_over_the_smallest_tables(spark):
    """Registered functions whose columns plain Python can make."""
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    shards = queries.op5_sharding(spark, sf_dir).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in shards} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in texts.items()}
    counts = Counter(r.shard for r in shards)
    assert {r.law for r in shards} == {"rows"} and {r.grown_shard for r in shards} == {None} and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r.shard, r.slot) for r in shards) == [(s, k) for s in sorted(counts) for k in range(counts[s])]
    mixed = queries.op9_mixing(spark, sf_dir).collect()
    assert {r.doc_id: r["size"] for r in mixed} == {i: len(t.split()) for i, t in texts.items()}
    assert all(0 <= r.taken <= 2 * r["size"] and (r.first_slot is None) == (r.taken == 0) for r in mixed)
    spans = queries.op6_repeated_spans(spark, sf_dir).collect()
    assert {r.doc_id: r.n_bytes for r in spans} == {i: len(t) for i, t in texts.items()}
    near = {r.doc_id: r.n_shingles for r in queries.op4_ngram_join(spark, sf_dir).collect()}
    assert near == {i: len(shingle_set(t.decode())) for i, t in texts.items()}


def water(sizes, weights, share, most):
    """Targets by giving the excess away again and again."""
    target, capped, left = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in capped]
        total = sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * left / total > most * sizes[s]]
        if not over:
            return target | {s: weights[s] * left / total for s in free}
        for s in over:
            capped.add(s)
            target[s] = most * sizes[s]
            left -= target[s]


def test_mixing(spark, docs, empty):
    words = F.regexp_count(text_of("text"), F.lit(WORD))
    mix = lambda: mixing.mix(docs, size=words, carry=["doc_id", "text", "source"], block=8)
    documents, taken = mix()
    got = mixing.taken_words(documents, taken).select("row.*", "rid", "size", "source_size", "target", "taken").collect()
    rows = docs.collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in rows)
    sizes = {r.source: r.source_size for r in got}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2.0)
    used = Counter()
    for r in got:
        used[r.source] += r.taken
        assert abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
    assert all(abs(used[s] - want[s]) <= max(2, min(16, sizes[s] // 32)) for s in sizes)
    again = mixing.taken_words(*mix()).select("rid", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r.rid, r.taken) for r in got)
    pieces = mixing.mixed_rows(docs, documents, taken)
    assert pieces.columns == docs.columns
    slots = sorted((r.slot, r.rid) for r in taken.collect())
    place = {r.rid: r.doc_id for r in got}
    assert [r.doc_id for r in pieces.collect()] == [place[rid] for _, rid in slots]
    starts = Counter(slot for slot, _ in slots)
    assert max(starts.values()) <= 8  # a block of eight words starts as many documents at most
    assert sum(len((r.text or "").split()) for r in pieces.collect()) == sum(used.values())
    assert mixing.taken_words(*mixing.mix(empty, size=words, carry=["doc_id"])).count() == 0


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(8)
    clean = [f"plain{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice(clean, 60))
        toxic = i % 5 == 0
        if toxic:
            for at in rng.integers(0, 60, 4):
                words[at] = str(rng.choice(["vileness", "nastya", "nastyb", "nastyc", "horrid!"]))
        rows.append((i, " ".join(words)))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "vileness horrid")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(table, known).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    wrong = [i for i in range(900) if got[i].predicted != (i % 5 == 0)]
    assert len(wrong) < 20 and got[5000].predicted == got[5001].predicted == 0 and got[None].predicted == 1
    none = toxicity.score(docs, known.limit(0)).collect()
    assert len(none) == docs.count() and not any(r.predicted for r in none)
    assert toxicity.score(empty, known).count() == 0


def test_rows_keep_their_numbers_however_scans_are_cut(spark, docs):
    words = F.regexp_count(text_of("text"), F.lit(WORD))

    def results():
        return [
            exact_dedup.mark_copies(docs).select("row.doc_id", "keep_id", "group_size", "kept"),
            exact_dedup.drop_copies(docs).select("doc_id", "text"),
            ngram_join.drop_near_duplicates(docs).select("doc_id", "text"),
            repeated_spans.remove_repeats(docs).select("doc_id", "n_removed", "kept_sha256"),
            mixing.mixed_rows(docs, *mixing.mix(docs, size=words, carry=["doc_id"], block=8)).select("doc_id", "text"),
            numbered(docs).select(RID, "doc_id"),
        ]

    want = [sorted(map(str, df.collect())) for df in results()]
    planned = results()
    cuts = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    try:
        for name, value in cuts.items():
            spark.conf.set(name, value)
        assert docs.select("doc_id").rdd.getNumPartitions() == 1
        assert [sorted(map(str, df.collect())) for df in planned] == want
    finally:
        for name in cuts:
            spark.conf.unset(name)


def test_what_is_no_table_is_stored_before_it_is_numbered(spark, docs):
    for rows in (docs.union(docs), docs.withColumn("x", F.rand()), spark.range(20), docs.select(F.explode(F.sequence(F.lit(1), F.lit(3))))):
        own = numbered(rows)
        assert own.select(RID).distinct().count() == own.count() == rows.count()
        assert sorted(map(str, own.collect())) == sorted(map(str, own.collect()))


def test_signatures_meet_at_other_similarities():
    rng = np.random.default_rng(10)
    met = 0
    for _ in range(600):
        similarity = int(rng.choice([50, 80]))
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 300))).astype(np.uint64))
        b = a[rng.random(len(a)) > rng.choice([0, 0.05, 0.1, 0.19])]
        b = np.unique(np.append(b, rng.integers(0, 1 << 63, int(rng.integers(0, 2 + len(a) // 10))).astype(np.uint64)))
        if enough(len(np.intersect1d(a, b)), len(a) + len(b), similarity) and not np.array_equal(a, b):
            met += 1
            assert len(np.intersect1d(ngram_join.signatures(a, similarity), ngram_join.signatures(b, similarity)))
    assert met > 200
