"""Fill-in-the-middle, piece encoding, and vector codes against plain versions."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chordgrid.llm import fill_middle, piece_codec, queries, vector_codes

SMALL = "/root/testdata/sf0.001"


def filled(doc_id, text):
    """(n, form, prefix, middle, suffix, output) the plain way."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, docs, empty):
    rng = random.Random(4)
    texts = ["".join(rng.choices(["\x01", "\x02", "\x020", "\x021", "0", "1", "ab", "Z", " ", "\n", "é", "😀", "<", "P>", "S", "$0", "\\"], k=rng.randrange(30))) for _ in range(400)]
    rows = [*enumerate(texts, 100), (1, "<P>"), (2, "a<M>b"), (3, "\x01"), (4, "\x02" * 5000), (5, "ab " * 300_000), (6, None)]
    own = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    made = fill_middle.fill_in_middle(own).withColumn("back", fill_middle.restored(F.col("form"), F.col("output"))).collect()
    want = sorted((str(i), *map(repr, filled(i, t)), t or "") for i, t in map(tuple, own.collect()))
    assert sorted((str(r.doc_id), *map(repr, (r.n, r.form, r.prefix, r.middle, r.suffix, r.output)), r.back) for r in made) == want
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs).count() == docs.count() and fill_middle.fill_in_middle(empty).count() == 0


def test_registered_forms(spark):
    got = {r.doc_id: r for r in queries.op11_fill_middle(spark, SMALL).collect()}
    for row in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        n, form, p, m, _, output = filled(row.doc_id, row.text)
        r = got[row.doc_id]
        sizes = (None, None) if form == "plain" else (len(p), len(m))
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, *sizes)
        assert (r.output_sha256, r.restored_sha256) == tuple(hashlib.sha256(t.encode()).hexdigest() for t in (output, row.text or ""))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())


@given(st.text(alphabet=st.sampled_from(" ▁aAbtheinrs.,!<|>0x\n\t\r1½Σς中文学é́😀\x00�-=_"), max_size=60) | st.text(max_size=30))
@settings(max_examples=400, deadline=None)
def test_pieces_are_the_librarys(text):
    text = text.encode(errors="ignore").decode()
    own, theirs = piece_codec.codec(piece_codec.model_path()), test_pieces_are_the_librarys.__dict__.setdefault("theirs", sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path()))
    ids = own.encode(text)
    assert ids.tolist() == theirs.encode(text) and own.decode(ids) == theirs.decode(ids.tolist())


@given(st.lists(st.integers(0, 300) | st.integers(0, 31_999), max_size=20))
@settings(max_examples=400, deadline=None)
def test_any_ids_are_decoded_as_the_library_does(ids):
    own, theirs = piece_codec.codec(piece_codec.model_path()), test_any_ids_are_decoded_as_the_library_does.__dict__.setdefault("theirs", sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path()))
    assert own.decode(np.array(ids, np.int32)) == theirs.decode(ids)


def test_little_memory_changes_no_ids(library, monkeypatch):
    monkeypatch.setattr(piece_codec, "REMEMBERED", 3)
    own, rng = piece_codec.PieceCodec(piece_codec.model_path()), random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices(["the", "in", "ter", " ", "e", "s", "."], k=20))
        assert own.encode(text).tolist() == library.encode(text)
    assert max(len(own._words.young), len(own._words.old), len(own._goes.young)) <= 3


def test_prefixes_have_the_last_token_of_their_own_encoding(library):
    own = piece_codec.codec(piece_codec.model_path())
    text = " international   misunderstandings of Entwicklungsgeschichte"
    for end, token in [*enumerate(own.prefix_table(text), 1)][1:]:
        assert token == library.encode(text[1:end])[-1]


def test_piece_codec(spark, docs, empty, library):
    model = piece_codec.model_path()
    both = piece_codec.decode_ids(piece_codec.encode_texts(docs, model), model).collect()
    want = sorted((str(r.doc_id), library.encode(r.text or ""), library.decode(library.encode(r.text or ""))) for r in docs.collect())
    assert sorted((str(r.doc_id), r.ids, r.text) for r in both) == want
    assert sorted((str(r.doc_id), r.ids, r.text) for r in piece_codec.round_trip(docs, model).collect()) == want
    assert piece_codec.decode_ids(piece_codec.encode_texts(empty, model), model).count() == piece_codec.round_trip(empty, model).count() == 0
    missing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [r.text for r in piece_codec.decode_ids(missing, model).collect()] == [""]


def test_registered_pieces(spark, library):
    got = {r.doc_id: r for r in queries.op12_piece_codec(spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(got) == len(rows)
    for row in rows:
        ids, r = library.encode(row.text or ""), got[row.doc_id]
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, ids)), library.decode(ids))]
        assert [r.n_tokens, r.ids_sha256, r.decoded_sha256] == [len(ids), *sha]


def plain_codes(rows, parts, entries, rounds):
    """Codes, errors and codebooks by Python integers, every distance in full."""
    kept = [(i, label, [int(np.floor(4096 * np.float64(np.float32(x)))) for x in v]) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[2]))[:entries]
    books = [[cut(v, p) for _, _, v in first] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, c)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, _, v in kept:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, members in groups.items():
                books[p][k] = [sum(column) // len(members) for column in zip(*members)]
    found = []
    for i, label, v in kept:
        best = [near(cut(v, p), books[p]) for p in range(parts)]
        found.append((i, label, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return found, books


def test_vector_codes(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=12), 1).astype(np.float32)], int(i) % 3 if i % 5 else None) for i in rng.permutation(300)]
    rows += [(400, rows[0][1], 1), (400, rows[0][1], 1), (401, None, 1), (402, [1.0] * 11 + [None], 1), (403, [1.0] * 11 + [float("nan")], 2), (404, [float("inf")] + [0.0] * 11, None), (405, [0.0] * 12, None)]
    table = spark.createDataFrame([(*r, "x", -1.0) for r in rows], "vec_id long, embedding array<float>, label int, code string, error double").repartition(5)
    codes, books = vector_codes.compress(table, parts=4, entries=6, rounds=3)
    found, plain = plain_codes(rows, 4, 6, 3)
    of_label = {}
    for _, label, _, error in found:
        of_label[label] = of_label.get(label, 0) + error
    assert sorted(map(tuple, codes.collect())) == sorted((i, code, error, of_label[label]) for i, label, code, error in found)
    assert books.entries.tolist() == plain
    assert books.sha256 == hashlib.sha256(",".join(str(c) for book in plain for entry in book for c in entry).encode()).hexdigest()


def test_few_vectors_and_none(spark):
    table = spark.createDataFrame([(2, [1.0, 2.0], 0), (None, [3.0, 4.0], 0), (1, [1.0, 2.0], 0)], "vec_id long, embedding array<float>, label int")
    codes, books = vector_codes.compress(table, parts=2)
    assert books.entries.shape == (2, 3, 1) and {(r.vec_id, r.code, r.error) for r in codes.collect()} == {(1, "0000", 0), (2, "0000", 0), (None, "0202", 0)}
    nothing, books = vector_codes.compress(table.limit(0))
    assert books is None and nothing.count() == 0 and nothing.columns == codes.columns
    with pytest.raises(ValueError):
        vector_codes.compress(table, parts=3)


@given(st.data())
@settings(max_examples=80, deadline=None)
def test_partial_distances_find_the_nearest_entry(data):
    width, entries, n = data.draw(st.integers(1, 5)), data.draw(st.integers(1, 7)), data.draw(st.integers(0, 30))
    numbers = np.random.default_rng(data.draw(st.integers(0, 10_000)))
    parts, book = numbers.integers(-4, 4, (width, n)), numbers.integers(-4, 4, (entries, width))
    index, distance = vector_codes.nearest(parts, book)
    full = ((parts.T[:, None, :] - book[None]) ** 2).sum(2)
    assert (index == full.argmin(1)).all() and (distance == full.min(1)).all()
