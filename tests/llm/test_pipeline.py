"""Each stage's decisions take effect, and what follows sees only what was kept."""

from __future__ import annotations

import re
import tempfile
from collections import defaultdict
from dataclasses import replace
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from chordgrid.llm import exact_dedup, mixing, ngram_join, packing, queries, repeated_spans, sharding, tokenizing, toxicity
from chordgrid.llm.batches import lean
from chordgrid.llm.common import RID, WORD, numbered, stored, text_of
from chordgrid.llm.tokenizing import encoder, tokenizer_path
from chordgrid.operators.storage import shared_dir, shuffles_dropped
from chordgrid.operators.storage import shared_dir, shuffles_dropped
from chordgrid.operators.storage import shared_dir, shuffles_dropped
from tests.llm.conftest import CLASHES


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, sf_dir), "stage")
        kept.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name in ("toxicity", "exact dedup", "n-gram Jaccard join"):
            assert kept[-1] <= kept[-2] and docs.exceptAll(before).count() == 0
        if name == "mixing sources to target weights":
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert {"sequence_id", "offset"} <= set(docs.columns)


def test_near_copies_are_those_of_five_words_and_four_fifths(spark):
    rng = np.random.default_rng(9)
    texts = []
    for family in range(30):
        text = [f"f{family}w{i}" for i in range(50 if family < 5 else int(rng.integers(6, 300)))]
        texts.append(" ".join(text))
        for copy in range(4):
            other = list(text)
            for at in [25] if family < 5 and not copy else rng.integers(0, len(text), int(rng.integers(1, 2 + len(text) // 40))):
                other[at] = f"other{len(texts)}"
            texts.append(" ".join(other[: len(other) - int(rng.integers(0, 2 + len(text) // 12)) * (copy > 1)]))
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and least[i] != least[j]:
                low, high = sorted((least[i], least[j]))
                least = [low if n == high else n for n in least]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, table, "")
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(least))


def kept_plainly(rows):
    """The rows that stay of (doc_id, text): first of equal texts, then first of each group of near copies."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    firsts, seen = [], set()
    for key, text in order:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        if norm not in seen:
            seen.add(norm)
            firsts.append((key, text))
    words = [re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in firsts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = list(range(len(firsts)))
    for i in range(len(firsts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return [firsts[i] for i in sorted(set(group))]


def test_run_over_edge_rows_is_what_plain_stages_give(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stayed = [(r.doc_id, r.text) for r in corpus_pipeline.drop_toxic(spark, docs, corpus).collect()]
    kept = kept_plainly(stayed)
    size = {key: len(re.findall(WORD, text or "")) for key, text in kept}
    pieces = corpus_pipeline.run(spark, corpus).collect()
    assert {r.doc_id for r in pieces} <= {key for key, n in size.items() if n}
    windows = defaultdict(list)
    for r in pieces:
        windows[r.sequence_id].append((r.offset, r.length))
    for window in windows.values():
        window.sort()
        assert [at for at, _ in window] == [sum(n for _, n in window[:i]) for i in range(len(window))] and sum(n for _, n in window) <= 2048
    ids, taken = defaultdict(int), spark.read.parquet(f"{corpus}/documents.parquet")
    for r in pieces:
        ids[r.doc_id] += r.length
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources):
        taken = stored(stage(spark, taken, corpus), "plain")
        assert taken.columns == docs.columns and all(r[name] == 1 for r in taken.select(*[f"`{c}`" for c in CLASHES]).collect() for name in CLASHES)
        if stage is corpus_pipeline.drop_near_copies:
            assert sorted(map(str, taken.select("doc_id", "text").collect())) == sorted(f"Row(doc_id={k!r}, text={t!r})" for k, t in kept)
    encode, want, words = encoder(tokenizer_path()), defaultdict(int), defaultdict(int)
    for r in taken.collect():
        want[r.doc_id] += len(encode.encode((r.text or "").encode())) // 4 + 1
        words[r.doc_id] += len(re.findall(WORD, r.text))
    assert ids == want and all(words[key] <= 2 * size[key] for key in words)


def test_run_over_no_rows(spark, corpus, tmp_path):
    for name, n in (("documents", 0), ("labels", 20)):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(n).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_named_like_inner_ones_are_the_callers(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = docs.count()
    own = numbered(docs)
    assert own.select(RID).distinct().count() == rows and numbered(own) is own
    assert all(own.columns.count(name) == 1 for name in CLASHES) and own.where("`__rid` = 1 AND `_metadata` = 1").count() == rows
    assert sharding.shard(docs, F.octet_length(text_of("text")), bucket_bytes=5000).where("row.`__rid` = 1").count() == rows
    assert exact_dedup.mark_copies(docs).where("row.`__rid` = 1").count() == rows
    assert repeated_spans.remove_repeats(docs).count() == ngram_join.near_duplicates(docs).count() == rows
    mixed = mixing.mixed_rows(docs, *mixing.mix(docs, size=F.regexp_count(text_of("text"), F.lit(WORD)), carry=docs.columns))
    assert mixed.columns == docs.columns and mixed.where("`__rid` <> 1 OR `__slot` <> 1 OR `__size` <> 1").count() == 0
    for name in ("op3_packing", "op4_ngram_join", "op5_sharding", "op6_repeated_spans", "op7_exact_dedup", "op8_token_counts", "op9_mixing"):
        assert queries.QUERIES[name](spark, corpus).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_several_buckets_in_a_task(spark, docs, monkeypatch):
    """Several buckets in a task hold the same rows, none lost, and a rerun gives the same order."""
    monkeypatch.setattr(sharding, "RANGES", 2)
    monkeypatch.setattr(sharding, "RANGE_BUCKETS", 4)
    size = F.octet_length(text_of("text"))
    made = sharding.shard(docs, size, bucket_bytes=3000).select("row.doc_id", "row.text", "shard", "slot")
    once, again = made.collect(), made.collect()
    assert sorted(map(str, once)) == sorted(map(str, again)) and len(once) == docs.count()
    assert sorted(map(str, made.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    assert max(r.shard for r in once) == 15 and {r.slot for r in once} == {0, 1}


def test_idle_workers_hold_no_words_of_packing(spark, docs):
    """Spark keeps Python workers for later stages, which share an executor's memory with what they hold."""
    packing.pack(docs, tokenizer_path()).collect()

    def held(batches):
        yield from (pa.RecordBatch.from_pydict({"n": [sum(len(e.ids) for e in tokenizing._ENCODERS.values())] * len(b)}) for b in batches)

    assert {r.n for r in spark.range(0, 400, 1, 8).mapInArrow(held, "n long").collect()} == {0}


def test_mining_in_parts_finds_the_same_features(spark):
    rows = [(i, int(i % 5 == 0), f"own{i} words {'vile wretch' if i % 5 == 0 else 'good friend'} and text{i % 7}".encode()) for i in range(200)]
    sample = spark.createDataFrame(rows, "doc_id long, toxic int, text binary").repartition(2)
    whole = toxicity.mine(sample, toxicity.Settings())
    parts = toxicity.mine(sample, replace(toxicity.Settings(), names_kept=20))
    assert whole.features and (whole.features, whole.levels, whole.ratios) == (parts.features, parts.levels, parts.ratios)


def test_near_copies_leave_no_signatures_and_no_shuffles_behind(spark, docs):
    def left():
        return {p for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet") if "signatures" in pq.read_schema(p).names}

    def shuffled():
        return set(Path(tempfile.gettempdir()).glob("blockmgr-*/*/shuffle_*.data"))

    stored_before, shuffled_before, setting = left(), shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    ngram_join.near_duplicates(docs)
    assert left() <= stored_before and not shuffled() - shuffled_before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    with shuffles_dropped(spark):
        assert docs.groupBy("doc_id").count().count() == 16


def test_whole_places_carry_only_the_places_a_pair_may_have_met_at(spark, monkeypatch):
    """Sets bring to a place the smaller names among those still apart, and each pair is found once."""
    seen = tempfile.mkdtemp(prefix="places-")
    best = ngram_join.best_partners

    def noted(table, similarity, most):
        with open(f"{seen}/{table.column('place')[0].as_py()}", "w") as out:
            out.write(repr([(p.as_py(), q.as_py()) for p, q in zip(table.column("place"), table.column("places"))]))
        return best(table, similarity, most)

    monkeypatch.setattr(ngram_join, "best_partners", noted)
    point = ngram_join.point(np.arange(40, dtype=np.uint64))
    members = spark.createDataFrame([(p, n, n, 3) for p in (5, 2, 9) for n in (1, 2, 3)], "place long, node long, root long, n long")
    nodes = spark.createDataFrame([(n, n, 40, bytearray(point.tobytes())) for n in (1, 2, 3)], "node long, rid long, n_shingles long, point binary")
    failed = spark.createDataFrame([], "node long, other long")
    found = ngram_join.candidates(members, failed, nodes, 90, 8, True).collect()
    assert sorted(map(tuple, found)) == [(2, 1, 2), (2, 1, 3), (2, 2, 3)]
    noted_rows = [row for f in Path(seen).iterdir() for row in eval(f.read_text())]
    assert sorted((p, sorted(q)) for p, q in noted_rows) == [(2, [])] * 3 + [(5, [2])] * 3 + [(9, [2, 5])] * 3


def test_a_lean_task_gives_back_what_it_freed():
    def held():
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024

    def run(batches):
        blocks = [pa.allocate_buffer(30_000) for _ in range(6000)]
        for block in blocks:
            np.frombuffer(block, np.uint8)[:] = 1
        last.append(blocks.pop())
        yield from batches

    last: list[pa.Buffer] = []
    batch = pa.RecordBatch.from_pydict({"n": [1, 2]})
    before = held()
    assert list(lean(run)(iter([batch]))) == [batch] and held() - before < 60


def test_idle_workers_hold_no_words_of_packing(spark, docs):
    """Spark keeps Python workers for later stages, which share an executor's memory with what they hold."""
    packing.pack(docs, tokenizer_path()).collect()

    def held(batches):
        yield from (pa.RecordBatch.from_pydict({"n": [sum(len(e.ids) for e in tokenizing._ENCODERS.values())] * len(b)}) for b in batches)

    assert {r.n for r in spark.range(0, 400, 1, 8).mapInArrow(held, "n long").collect()} == {0}


def test_mining_in_parts_finds_the_same_features(spark):
    rows = [(i, int(i % 5 == 0), f"own{i} words {'vile wretch' if i % 5 == 0 else 'good friend'} and text{i % 7}".encode()) for i in range(200)]
    sample = spark.createDataFrame(rows, "doc_id long, toxic int, text binary").repartition(2)
    whole = toxicity.mine(sample, toxicity.Settings())
    parts = toxicity.mine(sample, replace(toxicity.Settings(), names_kept=20))
    assert whole.features and (whole.features, whole.levels, whole.ratios) == (parts.features, parts.levels, parts.ratios)


def test_near_copies_leave_no_signatures_and_no_shuffles_behind(spark, docs):
    def left():
        return {p for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet") if "signatures" in pq.read_schema(p).names}

    def shuffled():
        return set(Path(tempfile.gettempdir()).glob("blockmgr-*/*/shuffle_*.data"))

    stored_before, shuffled_before, setting = left(), shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    ngram_join.near_duplicates(docs)
    assert left() <= stored_before and not shuffled() - shuffled_before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    with shuffles_dropped(spark):
        assert docs.groupBy("doc_id").count().count() == 16


def test_whole_places_carry_only_the_places_a_pair_may_have_met_at(spark, monkeypatch):
    """Sets bring to a place the smaller names among those still apart, and each pair is found once."""
    seen = tempfile.mkdtemp(prefix="places-")
    best = ngram_join.best_partners

    def noted(table, similarity, most):
        with open(f"{seen}/{table.column('place')[0].as_py()}", "w") as out:
            out.write(repr([(p.as_py(), q.as_py()) for p, q in zip(table.column("place"), table.column("places"))]))
        return best(table, similarity, most)

    monkeypatch.setattr(ngram_join, "best_partners", noted)
    point = ngram_join.point(np.arange(40, dtype=np.uint64))
    members = spark.createDataFrame([(p, n, n, 3) for p in (5, 2, 9) for n in (1, 2, 3)], "place long, node long, root long, n long")
    nodes = spark.createDataFrame([(n, n, 40, bytearray(point.tobytes())) for n in (1, 2, 3)], "node long, rid long, n_shingles long, point binary")
    failed = spark.createDataFrame([], "node long, other long")
    found = ngram_join.candidates(members, failed, nodes, 90, 8, True).collect()
    assert sorted(map(tuple, found)) == [(2, 1, 2), (2, 1, 3), (2, 2, 3)]
    noted_rows = [row for f in Path(seen).iterdir() for row in eval(f.read_text())]
    assert sorted((p, sorted(q)) for p, q in noted_rows) == [(2, [])] * 3 + [(5, [2])] * 3 + [(9, [2, 5])] * 3


def test_idle_workers_hold_no_words_of_packing(spark, docs):
    """Spark keeps Python workers for later stages, which share an executor's memory with what they hold."""
    packing.pack(docs, tokenizer_path()).collect()

    def held(batches):
        yield from (pa.RecordBatch.from_pydict({"n": [sum(len(e.ids) for e in tokenizing._ENCODERS.values())] * len(b)}) for b in batches)

    assert {r.n for r in spark.range(0, 400, 1, 8).mapInArrow(held, "n long").collect()} == {0}


def test_mining_in_parts_finds_the_same_features(spark):
    rows = [(i, int(i % 5 == 0), f"own{i} words {'vile wretch' if i % 5 == 0 else 'good friend'} and text{i % 7}".encode()) for i in range(200)]
    sample = spark.createDataFrame(rows, "doc_id long, toxic int, text binary").repartition(2)
    whole = toxicity.mine(sample, toxicity.Settings())
    parts = toxicity.mine(sample, replace(toxicity.Settings(), names_kept=20))
    assert whole.features and (whole.features, whole.levels, whole.ratios) == (parts.features, parts.levels, parts.ratios)


def test_near_copies_leave_no_signatures_and_no_shuffles_behind(spark, docs):
    def left():
        return {p for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet") if "signatures" in pq.read_schema(p).names}

    def shuffled():
        return set(Path(tempfile.gettempdir()).glob("blockmgr-*/*/shuffle_*.data"))

    stored_before, shuffled_before, setting = left(), shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    ngram_join.near_duplicates(docs)
    assert left() <= stored_before and not shuffled() - shuffled_before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    with shuffles_dropped(spark):
        assert docs.groupBy("doc_id").count().count() == 16


def test_whole_places_carry_only_the_places_a_pair_may_have_met_at(spark, monkeypatch):
    """Sets bring to a place the smaller names among those still apart, and each pair is found once."""
    seen = tempfile.mkdtemp(prefix="places-")
    best = ngram_join.best_partners

    def noted(table, similarity, most):
        with open(f"{seen}/{table.column('place')[0].as_py()}", "w") as out:
            out.write(repr([(p.as_py(), q.as_py()) for p, q in zip(table.column("place"), table.column("places"))]))
        return best(table, similarity, most)

    monkeypatch.setattr(ngram_join, "best_partners", noted)
    point = ngram_join.point(np.arange(40, dtype=np.uint64))
    members = spark.createDataFrame([(p, n, n, 3) for p in (5, 2, 9) for n in (1, 2, 3)], "place long, node long, root long, n long")
    nodes = spark.createDataFrame([(n, n, 40, bytearray(point.tobytes())) for n in (1, 2, 3)], "node long, rid long, n_shingles long, point binary")
    failed = spark.createDataFrame([], "node long, other long")
    found = ngram_join.candidates(members, failed, nodes, 90, 8, True).collect()
    assert sorted(map(tuple, found)) == [(2, 1, 2), (2, 1, 3), (2, 2, 3)]
    noted_rows = [row for f in Path(seen).iterdir() for row in eval(f.read_text())]
    assert sorted((p, sorted(q)) for p, q in noted_rows) == [(2, [])] * 3 + [(5, [2])] * 3 + [(9, [2, 5])] * 3
