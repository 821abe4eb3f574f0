"""Operators that read each text by itself."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chordgrid.llm import licences, media, packing, token_counts
from chordgrid.llm.tokenizing import WordEncoder, segments, tokenizer_path


def ids_of(texts):
    return [e.ids for e in Tokenizer.from_file(tokenizer_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@given(st.text(alphabet=st.sampled_from(" aAbéÉß'’s.,!#<|>\n\t1½Σς中́ "), max_size=40))
@settings(max_examples=150, deadline=None)
def test_words_are_encoded_as_the_library_does(text):
    encoder = test_words_are_encoded_as_the_library_does.__dict__.setdefault("encoder", WordEncoder(tokenizer_path()))
    tokenizer = test_words_are_encoded_as_the_library_does.__dict__.setdefault("tokenizer", Tokenizer.from_file(tokenizer_path()))
    assert np.frombuffer(encoder.encode(text.encode(), 8), np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_segments_join_to_the_text():
    text = b"ab cd\tefg  h" * 50
    assert b"".join(segments(text, 7)) == text and max(map(len, segments(text, 7))) < 13


def test_token_counts(spark, docs, empty):
    got = token_counts.count_tokens(docs, tokenizer_path(), batch_bytes=1000).collect()
    rows = docs.collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(i)) for r, i in zip(rows, ids_of([r.text for r in rows])))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert {r.doc_id for r in got if r.over_limit} == {7, 14} - ({14} if max(n for i, _, n in want if i == "14") <= 2048 else set())
    assert token_counts.count_tokens(empty, tokenizer_path()).count() == 0


def test_packing(spark, docs, empty):
    rows = docs.collect()
    want = sorted(((str(r.doc_id), [*i, 1]) for r, i in zip(rows, ids_of([r.text for r in rows]))), key=str)
    got = packing.pack(docs, tokenizer_path()).collect()
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    by_doc = defaultdict(list)
    for r in got:
        by_doc[str(r.doc_id), r.doc_tokens].append(r)
    for name, ids in want:
        pieces = by_doc[name, len(ids)]
        copies = sum(1 for other in want if other == (name, ids))
        assert sum(p.length for p in pieces) == copies * len(ids)
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], np.uint32).tobytes()) for p in pieces)
    assert packing.pack(empty, tokenizer_path()).count() == 0


@given(st.lists(st.integers(1, 100), max_size=60), st.sets(st.integers(0, 59)))
@settings(max_examples=60, deadline=None)
def test_windows_hold_every_piece_once(sizes, loose):
    groups = packing.fitted(sizes, 100, {i for i in loose if i < len(sizes)})
    held = defaultdict(list)
    for group in groups:
        assert 0 < sum(length for _, _, length in group) <= 100
        for i, start, length in group:
            held[i].append((start, length))
    assert sorted(held) == list(range(len(sizes)))
    for i, parts in held.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == sizes[i]
    assert len(groups) <= max(1, -(-sum(sizes) // 100)) * 1.1 + 1


def test_windows_rise_until_documents_that_fit_stay_whole(spark):
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), tokenizer_path()).collect()
    pieces, used = defaultdict(int), defaultdict(int)
    for r in got:
        used[r.sequence_id] += r.length
        if r.doc_tokens <= 2048:
            pieces[r.doc_id, r.doc_tokens] += 1
    assert sum(used.values()) / (2048 * len(used)) > 0.98
    assert set(pieces.values()) == {1}


def test_sizes_that_never_fit_together_are_cut():
    groups = packing.fitted([51] * 100, 100)
    assert len(groups) <= 57 and sum(length for g in groups for _, _, length in g) == 5100
    assert any(length < 51 for g in groups for _, _, length in g)


def test_words_without_blanks_are_cut_at_marks():
    for unit in ("些文字，没有空白。", "letters,without.blanks;"):
        text = (unit * 4000).encode()
        parts = list(segments(text, 2000, marks=True))
        assert b"".join(parts) == text and max(map(len, parts)) < 4100
        assert list(segments(text, 2000)) == [text]
        ids = np.frombuffer(WordEncoder(tokenizer_path()).encode(text, 2000), np.uint32).tolist()
        assert ids == Tokenizer.from_file(tokenizer_path()).encode(text.decode(), add_special_tokens=False).ids


def test_media(spark, docs, empty):
    got = media.read_media(media.store_texts(docs)).collect()
    want = []
    for r in docs.collect():
        data = (r.text or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        want.append((str(r.doc_id), len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (1, 2)}) == 1
    assert media.read_media(media.store_texts(empty)).count() == 0


def filtered(image, kinds):
    """A plain writer that uses each row's filter."""
    h, w, c = image.shape
    out = bytearray()
    for y in range(h):
        out.append(kinds[y])
        for x in range(w):
            for k in range(c):
                a, b = int(image[y, x - 1, k]) if x else 0, int(image[y - 1, x, k]) if y else 0
                corner = int(image[y - 1, x - 1, k]) if x and y else 0
                p = a + b - corner
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - corner), 2, corner))[2]
                out.append((int(image[y, x, k]) - (0, a, b, (a + b) // 2, near)[kinds[y]]) % 256)
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0])
    return media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", zlib.compress(bytes(out))) + media._chunk(b"IEND", b"")


def test_png_filters_and_checksums():
    rng = np.random.default_rng(2)
    for _ in range(25):
        h, w, c = (int(n) for n in (rng.integers(1, 14), rng.integers(1, 14), rng.integers(1, 5)))
        image = rng.integers(0, 256, (h, w, c)).astype(np.uint8)
        assert (media.decode_png(filtered(image, rng.integers(0, 5, h))) == image).all()
    png = media.encode_png(np.arange(128, dtype=np.uint8).reshape(2, 64))
    for broken in (png[:-5], png[:40] + b"\0\0" + png[42:], b"x" + png[1:], png[:-12]):
        with pytest.raises(ValueError):
            media.decode_png(broken)


def test_licences(spark, docs, empty):
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert got[13].licences == ["MIT"] and got[4].licences == [] and got[7].sentence_ids == []
    assert licences.scan(empty).count() == 0
    book, rules = licences.SentenceBook(licences.SENTENCES), licences.RuleBook(licences.RULES)
    s = licences.SENTENCES
    bsd = " * Copyright 2020 The Authors.\n * All rights reserved.\n *\n" + "\n".join(s[k].replace("<x>", "the owner") for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"))
    names = [n for n, _ in book.names("Some text.\n" + bsd + "\nMore text. Licensed under CC BY 4.0.\nEnd")]
    assert rules.match(names) == (["BSD-3-Clause", "CC-BY-4.0"], [])
    wrapped = s["mit-grant"].replace("software and", "software\n# and") + "\n" + s["mit-notice"] + "\n" + s["mit-as-is"]
    assert rules.match([n for n, _ in book.names("MIT License\n\n" + wrapped)])[0] == ["MIT"]
    assert rules.match(["bsd-names"]) == ([], ["bsd-names"])


def test_every_sentence_and_rule_is_found_in_its_own_text():
    book, rules = licences.SentenceBook(licences.SENTENCES), licences.RuleBook(licences.RULES)
    own = {name: sentence.replace("<x>", "the owner") for name, sentence in licences.SENTENCES.items()}
    for name, sentence in own.items():
        assert list(book.names(sentence)) == [(name, 0)]
        assert [n for n, _ in book.names("Before.\n# " + sentence.replace(" ", "\n# ") + "\n\nAfter it.")] == [name]
    for licence, form in licences.RULES:
        for parts in (form.split(), [part for part in form.split() if not part.endswith("?")]):
            text = "\n\n".join(own[part.rstrip("?")] for part in parts)
            assert rules.match([n for n, _ in book.names(text)]) == ([licence], [])
    assert [n for n, _ in book.names("Copyright 2020 the owner. All rights reserved.")] == ["copyright", "rights"]
