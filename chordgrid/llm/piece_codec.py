"""SentencePiece byte-pair models: encoding by a table of each prefix's last token, and decoding.

In such a model any two neighbours whose joint text is a piece may merge, the best score first, the leftmost of equals.
A merge depends on what stands on its own two sides alone, so tokens follow each other in some encoding exactly if each
pair of neighbours does by itself. Every prefix of a text therefore has one last token: the only piece that ends there,
stays whole by itself, and goes with the last token of the prefix before it. An automaton finds the pieces that end at
each place; the ids are read off the table from its end.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chordgrid.llm.common import text_of

#: Pieces and texts have plain spaces here in place of the model's visible ones; the library takes both for the same.
SPACE = "▁"
#: Words and pairs of tokens that a worker remembers at least and, twice that, at most; and the longest word it does.
REMEMBERED, LONGEST = 1 << 17, 64
#: Rows that are encoded at a time.
ROWS = 512
#: How texts are cut into words, finest first. A way is safe if it cuts no piece: then nothing merges over a cut.
CUTS = (r" *[^\W\d_²³¹]+| *\d| *(?:[^\w ]|[_²³¹])+| +", r" *[^\W\d_²³¹]+| *(?:[^\w ]|[\d_²³¹])+| +", r" *[^ ]+| +", r"(?s).+")
_NONE = float("inf")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """The path of a public model file; the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Remembered:
    """A table of bounded size: when the young half is full it becomes the old one, and what is asked for again moves back."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self[key] = value
        return value

    def __setitem__(self, key, value) -> None:
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[key] = value


class PieceCodec:
    """Ids of a text, and the text of ids, as the library of the model gives them."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as formats

        model = formats.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds, rules = formats.ModelProto.SentencePiece, model.normalizer_spec
        if model.trainer_spec.model_type != formats.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("the model is not a byte-pair model with byte fallback")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces):
            raise ValueError("the model normalises texts beyond a first space and visible spaces")
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids, self.texts, self.bytes_of, self.unknown = [0] * 256, [], {}, -1
        for i, piece in enumerate(model.pieces):
            text = piece.piece.replace(SPACE, " ")
            self.texts.append(text)
            if piece.type == kinds.NORMAL:
                self.rank[text], self.ids[text] = -piece.score, i
            elif piece.type == kinds.BYTE:
                value = int(piece.piece[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, value
            elif piece.type == kinds.CONTROL:
                self.texts[i] = ""
            elif piece.type == kinds.UNKNOWN:
                self.texts[i], self.unknown = model.trainer_spec.unk_surface, i
            else:
                raise ValueError(f"pieces of type {piece.type} are not known here")
        if any(c not in self.ids for c in set("".join(self.ids))):
            raise ValueError("a character of a piece is no piece itself")
        ways = map(re.compile, CUTS)
        self.words = next(way for way in ways if all(way.fullmatch(piece) for piece in self.ids))
        self.last_edges: dict[int, list[tuple[float, str]]] = {}
        self.first_edges: dict[int, list[tuple[float, str]]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            steps = self._merges(piece)
            if steps is not None:
                self.last_edges[i] = [(0.0, piece[-1]), *[(rank, last) for rank, _, last in steps]]
                self.first_edges[i] = [(0.0, piece[0]), *[(rank, first) for rank, first, _ in steps]]
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self._goes, self._words = _Remembered(), _Remembered()

    def _merges(self, piece: str) -> list[tuple[float, str, str]] | None:
        """(rank, first symbol, last symbol) after each merge of a piece by itself; None if it doesn't become one token."""
        symbols, steps = list(piece), []
        while len(symbols) > 1:
            ranks = [self.rank.get(a + b, _NONE) for a, b in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == _NONE:
                return None
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            steps.append((best, symbols[0], symbols[-1]))
        return steps

    def _go_together(self, a: int, b: int) -> bool:
        """Whether two tokens stay apart when their texts stand side by side.

        Their own merges run side by side, the better one first, and no merge over the border may come before the next of them.
        """
        left, right, rank = self.last_edges[a], self.first_edges[b], self.rank
        if self.texts[a] + self.texts[b] in rank:
            return False  # in the end the two would merge as they are
        i = j = 0
        while True:
            over = rank.get(left[i][1] + right[j][1], _NONE)
            of_left = left[i + 1][0] if i + 1 < len(left) else _NONE
            of_right = right[j + 1][0] if j + 1 < len(right) else _NONE
            if over < of_left and over <= of_right and over != _NONE:
                return False
            if of_left == of_right == _NONE:
                return True
            if of_left <= of_right:
                i += 1
            else:
                j += 1

    def prefix_table(self, text: str) -> list[int]:
        """For each prefix of ``text``, shortest first, its last token; -1 for a character that is no piece."""
        last, goes = [-1] * len(text), self._goes
        lately = goes.young
        for end, (length, token) in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            if end >= length and (before := last[end - length]) >= 0:
                pair = before << 32 | token
                known = lately.get(pair)
                if known is None:
                    known = goes.get(pair)
                    if known is None:
                        known = goes[pair] = self._go_together(before, token)
                    lately = goes.young
                if not known:
                    continue
            last[end] = token
        return last

    def _ids(self, text: str) -> bytes:
        last, ids, at = self.prefix_table(text), [], len(text)
        while at:
            token = last[at - 1]
            if token < 0:
                ids += [self.byte_ids[b] for b in reversed(text[at - 1].encode())]
                at -= 1
            else:
                ids.append(token)
                at -= len(self.texts[token])
        ids.reverse()
        return array("i", ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if not text:
            return np.zeros(0, np.int32)
        words, out = self._words, []
        for word in self.words.findall(" " + text.replace(SPACE, " ")):
            ids = words.young.get(word) or words.get(word)
            if ids is None:
                ids = self._ids(word)
                if len(word) <= LONGEST:
                    words[word] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces with their spaces, runs of bytes as UTF-8, without the space before the first piece."""
        texts, ids = self.texts, ids.tolist()
        if self.bytes_of.keys().isdisjoint(ids) and self.unknown not in ids[:1]:
            out = "".join([texts[i] for i in ids])
            return out[1:] if out[:1] == " " else out
        parts, run, begun = [], bytearray(), False
        for i in ids:
            value = self.bytes_of.get(i)
            if value is not None:
                run.append(value)
                continue
            if run:
                parts.append(_readable(run))
                begun, run = True, bytearray()
            piece = texts[i]
            if not begun and piece:
                begun, piece = True, piece[1:] if piece[0] == " " and i != self.unknown else piece
            parts.append(piece)
        parts.append(_readable(run))
        return "".join(parts)


def _readable(run: bytearray) -> str:
    """Bytes as UTF-8; each byte that is part of no character becomes U+FFFD."""
    out, data = [], bytes(run)
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as error:
            out.append(data[: error.start].decode() + "�")
            data = data[error.start + 1 :]
    return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One codec for each model and worker."""
    return PieceCodec(path)


def _encoded(own: PieceCodec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) of batches of (doc_id, text), a few rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            found = [own.encode(t) for t in part.column(1).to_pylist()]
            ends = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(f) for f in found], out=ends[1:])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], names=["doc_id", "ids"])


def _decoded(own: PieceCodec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids, text) of batches of (doc_id, ids)."""
    for batch in batches:
        ids = batch.column(1)
        ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        texts = [own.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])


def _given(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))


def encode_texts(df: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, ids) for each row of ``df``; ``model`` is the path of a model file on every executor.

    A null or empty text has no ids; a null doc_id stays null; repeated rows each give a row; other columns aren't read,
    so their names can't clash; an empty table gives an empty result. A text is encoded whole, word by word, so memory
    is that of a few rows, their longest word, and what a worker remembers.
    """
    return _given(df, doc_id, text).mapInArrow(lambda batches: _encoded(codec(model), batches), "doc_id long, ids array<int>")


def decode_ids(df: DataFrame, model: str) -> DataFrame:
    """``df`` (doc_id, ids) with the text of the ids; null ids are no ids."""
    given = df.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return given.mapInArrow(lambda batches: _decoded(codec(model), batches), "doc_id long, ids array<int>, text string")


def round_trip(df: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``decode_ids`` of ``encode_texts`` within one worker: (doc_id, ids, text), with the same rules for rows."""
    return _given(df, doc_id, text).mapInArrow(lambda batches: _decoded(codec(model), _encoded(codec(model), batches)), "doc_id long, ids array<int>, text string")
