"""Token ids of whole texts, equal to the library's, computed word by word with a bounded memory of words.

The vocabulary's pre-tokenizer drops white space, so no token and no special string spans an ASCII white-space
byte, and no canonical composition crosses one: those bytes are safe boundaries. Texts are cut there into segments,
segments into words, and each distinct word is encoded once by the library (in batches) and remembered.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: The end of letters (ASCII, or a Han character) before white space or a mark that no special string has.
_LETTER_THEN_MARK = re.compile(rb"(?:[A-Za-z]|[\xe4-\xe9][\x80-\xbf]{2})(?=[\x20\x09-\x0D]|[,.;:!?](?![\x80-\xff])|\xe3\x80[\x81\x82]|\xef\xbc[\x81\x8c\x9a\x9b\x9f])")
#: ASCII punctuation without the apostrophe, which the vocabulary joins to letters.
_MARKS = string.punctuation.replace("'", "").encode()
_PROBES = [w.encode() for w in ("abcdefghijklmnopqrstuvwxyz", "Word,", "straße.", "Élan;", "x###", "naïveté***")]


def segments(text: bytes, limit: int, marks: bool = False) -> Iterator[bytes]:
    """``text`` in pieces of about ``limit`` bytes, cut only before white space; one long word stays whole.

    With ``marks`` a word without white space for another ``limit`` bytes is cut before a punctuation mark that ends
    letters, where the pre-tokenizer cuts it as well.
    """
    at = 0
    while len(text) - at > limit:
        cut = _BLANK.search(text, at + limit, at + 2 * limit if marks else len(text))
        end = cut.start() if cut else None
        if cut is None and marks:
            cut = _LETTER_THEN_MARK.search(text, at + limit)
            end = cut.end() if cut else None
        if cut is None:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


class WordEncoder:
    """Encodes words with a ``tokenizers`` file; ``ids[word]`` gives little-endian unsigned 32-bit ids as bytes.

    Where the file's chain allows it (it is tried on a few words first), a word is taken apart at the safe boundary
    between letters and the ASCII punctuation that ends it, and the library's model encodes the letters alone. All else goes through the whole chain in batches.

    max_words bounds the memory: a fuller table is emptied before the next segment. Words over max_word_bytes are
    dropped from the table with the segment's other words.
    """

    def __init__(self, path: str, max_words: int = 800_000, max_word_bytes: int = 64) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_padding()
        self._tokenizer.no_truncation()
        self._byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._characters: dict[str, str] = {}
        self._max_words, self._max_word_bytes = max_words, max_word_bytes
        self.ids: dict[bytes, bytes] = {}
        self._plain = all(self._in_parts(w) == self._whole([w])[0] for w in _PROBES)

    def _whole(self, words: list[bytes]) -> list[bytes]:
        found = self._tokenizer.encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [array("I", encoding.ids).tobytes() for encoding in found]

    def _character(self, c: str) -> str:
        if c not in self._characters:
            self._characters[c] = self._byte_level.pre_tokenize_str(c)[0][0]
        return self._characters[c]

    def _letters(self, letters: bytes) -> bytes | None:
        """The ids of a lower-case ASCII word, or another word of letters only, by the model; None for any other word."""
        if letters.isalpha():
            form = letters.decode()
        else:
            text = letters.decode("utf-8", "replace")
            form = self._tokenizer.normalizer.normalize_str(text) if text.isalpha() else ""
            if not form.isalpha():
                return None
            form = "".join(map(self._character, form))
        return array("I", [t.id for t in self._tokenizer.model.tokenize(form)]).tobytes()

    def _in_parts(self, word: bytes) -> bytes | None:
        letters = word.rstrip(_MARKS)
        marks = word[len(letters) :]
        if not (letters.isalpha() or letters.decode("utf-8", "replace").isalpha()):
            return None  # the boundary is safe after a letter only
        letters = letters.lower()
        first = self.ids.get(letters)
        if first is None:
            first = self._letters(letters)
            if first is None:
                return None
            self.ids[letters] = first
        if not marks:
            return first
        if marks not in self.ids:
            self.ids[marks] = self._whole([marks])[0]
        return first + self.ids[marks]

    def learn(self, words: list[bytes]) -> None:
        """Make ``ids`` hold all of ``words``."""
        if len(self.ids) > self._max_words:
            self.ids.clear()
        rest = []
        for word in set(words).difference(self.ids):
            found = self._in_parts(word) if self._plain else None
            if found is None:
                rest.append(word)
            else:
                self.ids[word] = found
        if rest:
            self.ids.update(zip(rest, self._whole(rest)))

    def forget_long(self, words: list[bytes]) -> None:
        for word in words:
            if len(word) > self._max_word_bytes:
                self.ids.pop(word, None)

    def encode(self, text: bytes, segment_bytes: int = 1 << 20) -> bytes:
        """All ids of ``text``."""
        out = []
        for segment in segments(text, segment_bytes, marks=True):
            words = segment.split()
            self.learn(words)
            out.append(b"".join(map(self.ids.__getitem__, words)))
            self.forget_long(words)
        return b"".join(out)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This Python worker's encoder for a file; it stays for the worker's later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


@contextmanager
def task_encoder(path: str) -> Iterator[WordEncoder]:
    """The worker's encoder for the length of a task. Its words go with the task, as Spark keeps idle workers and their memory."""
    found = encoder(path)
    try:
        yield found
    finally:
        found.ids.clear()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
