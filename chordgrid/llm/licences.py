"""Licence scans: known licence sentences get identifiers, and sequences of identifiers match ordered rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chordgrid.llm.common import text_of

# Licence sentences as their licences have them; "<x>" stands for one to twelve words.
SENTENCES = {
    "mit-title": "The MIT License",
    "mit-named": "MIT License",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-this": "This project is licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache2-short": "Licensed under the Apache License, Version 2.0.",
    "apache2-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0",
    "apache2-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-licensed": "Licensed under the GNU General Public License, version 3.",
    "gpl2-licensed": "Licensed under the GNU General Public License, version 2.",
    "gpl2-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl3-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl21-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl3-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gnu-hope": "This <x> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gnu-see": "See the GNU <x> for more details.",
    "gnu-received": "You should have received a copy of the GNU <x> along with this <x>",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of <x> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY <x> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0.",
    "unlicense-title": "This is free and unencumbered software released into the public domain.",
    "cc-by-nc4": "Licensed under CC BY-NC 4.0.",
    "cc-by4": "Licensed under CC BY 4.0.",
    "cc-by-sa4": "Licensed under CC BY-SA 4.0.",
    "cc-by4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa4-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0-named": "Released under CC0 1.0.",
    "copyright": "Copyright <x>",
    "rights": "All rights reserved.",
}

# Ordered rules. The first that matches at a place wins; "?" marks what may be absent.
RULES = [
    ("MIT", "mit-title? mit-named? copyright? rights? mit-grant mit-notice mit-as-is mit-liability?"),
    ("ISC", "copyright? isc-grant"),
    ("BSD-3-Clause", "copyright? rights? bsd-grant bsd-source bsd-binary bsd-names bsd-as-is?"),
    ("BSD-2-Clause", "copyright? rights? bsd-grant bsd-source bsd-binary bsd-as-is?"),
    ("Apache-2.0", "copyright? rights? apache2-notice apache2-copy? apache2-as-is? apache2-see?"),
    ("AGPL-3.0-or-later", "copyright? agpl3-or-later gnu-hope? gnu-see? gnu-received?"),
    ("LGPL-2.1-or-later", "copyright? lgpl21-or-later gnu-hope? gnu-see? gnu-received?"),
    ("GPL-3.0-or-later", "copyright? gpl3-or-later gnu-hope? gnu-see? gnu-received?"),
    ("GPL-2.0-or-later", "copyright? gpl2-or-later gnu-hope? gnu-see? gnu-received?"),
    ("MPL-2.0", "mpl2-notice mpl2-copy?"),
    ("MIT", "mit-released"),
    ("MIT", "mit-licensed"),
    ("MIT", "mit-this"),
    ("MIT", "mit-title"),
    ("MIT", "mit-named"),
    ("Apache-2.0", "apache2-short"),
    ("GPL-3.0-only", "gpl3-work"),
    ("GPL-3.0-only", "gpl3-licensed"),
    ("GPL-2.0-only", "gpl2-licensed"),
    ("BSL-1.0", "boost-notice"),
    ("Unlicense", "unlicense-title"),
    ("CC-BY-NC-4.0", "cc-by-nc4"),
    ("CC-BY-NC-4.0", "cc-by-nc4-work"),
    ("CC-BY-SA-4.0", "cc-by-sa4"),
    ("CC-BY-SA-4.0", "cc-by-sa4-work"),
    ("CC-BY-4.0", "cc-by4"),
    ("CC-BY-4.0", "cc-by4-work"),
    ("CC0-1.0", "cc0-named"),
]

_SENTENCE_END = re.compile(r"(?<=[.!?:;])[\x20\x09-\x0D]+|\n[\x20\x09\x0B-\x0D]*\n")
_WORD = re.compile(r"<x>|[a-z0-9]+(?:[.+/-][a-z0-9]+)*")
_FIRST = re.compile(r"[^A-Za-z0-9]*([A-Za-z0-9]+(?:[.+/-][A-Za-z0-9]+)*)")
_FREE_WORDS = 12


def words_of(sentence: str) -> list[str]:
    """The normalised sentence: its lower-case words and numbers, without comment marks and punctuation."""
    return _WORD.findall(sentence.lower())


class SentenceBook:
    """Known sentences: those without free words by all their words, the others as patterns by their first word.

    A text is cut into passages at sentence ends. Some licence sentences hold such a cut themselves ("free software;
    you can"), so a sentence may extend over as many passages as it has by itself, and no more.
    """

    def __init__(self, sentences: dict[str, str]) -> None:
        self.whole: dict[str, tuple[str, int]] = {}
        self.free: dict[str, list[tuple[re.Pattern, str, int]]] = {}
        self.reach: dict[str, int] = {}  # by first word, the most passages of a sentence
        self.longest = 0
        for name, sentence in sentences.items():
            words = words_of(sentence)
            passages = sum(1 for passage in _SENTENCE_END.split(sentence) if words_of(passage))
            self.longest = max(self.longest, len(words) + _FREE_WORDS * words.count("<x>"))
            self.reach[words[0]] = max(passages, self.reach.get(words[0], 0))
            if "<x>" in words:
                gap = rf"\S+(?: \S+){{0,{_FREE_WORDS - 1}}}"
                form = " ".join(gap if w == "<x>" else re.escape(w) for w in words)
                self.free.setdefault(words[0], []).append((re.compile(form), name, passages))
            else:
                self.whole[" ".join(words)] = (name, passages)

    def name(self, words: list[str], passages: int = 1) -> str | None:
        if not words or words[0] not in self.reach or len(words) > self.longest:
            return None
        key = " ".join(words)
        if key in self.whole and passages <= self.whole[key][1]:
            return self.whole[key][0]
        return next((name for form, name, most in self.free.get(words[0], ()) if passages <= most and form.fullmatch(key)), None)

    def names(self, text: str) -> Iterator[tuple[str, int]]:
        """(identifier, number of its first passage) in order. A sentence may begin and end at any line of a passage."""
        lines = [
            (number, line, m[1].lower())
            for number, passage in enumerate(_SENTENCE_END.split(text))
            for line in passage.split("\n")
            if (m := _FIRST.match(line))
        ]
        at = 0
        while at < len(lines):
            found, words, passages = None, [], 0
            reach = self.reach.get(lines[at][2], 0)
            for end in range(at, len(lines) if reach else at):
                passages += end == at or lines[end][0] != lines[end - 1][0]
                words = words + words_of(lines[end][1])
                if passages > reach or len(words) > self.longest:
                    break
                if name := self.name(words, passages):
                    found = (name, end)  # the longest match counts
            if found:
                yield found[0], lines[at][0]
            at = found[1] + 1 if found else at + 1


class RuleBook:
    """Ordered rules over identifier sequences."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.rules = [(licence, [(part.rstrip("?"), part.endswith("?")) for part in form.split()]) for licence, form in rules]

    def match(self, names: list[str]) -> tuple[list[str], list[str]]:
        """The licences in order, and the identifiers that no rule took."""
        licences, left, at = [], [], 0
        while at < len(names):
            for licence, parts in self.rules:
                end = at
                for part, optional in parts:
                    if end < len(names) and names[end] == part:
                        end += 1
                    elif not optional:
                        break
                else:
                    licences.append(licence)
                    at = end
                    break
            else:
                left.append(names[at])
                at += 1
        return licences, left


SCHEMA = "doc_id long, licences array<string>, sentence_ids array<string>, sentence_numbers array<int>, unmatched array<string>"


def scan(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, str]] = RULES
) -> DataFrame:
    """One row for each row of ``df``: its licences in order of place, and the identifiers that they were read from.

    sentence_numbers are the places of the identified sentences among the text's sentences; unmatched holds
    identifiers that no rule took. A null or empty text has empty lists; a very long text is read whole; repeated rows
    each give a row; other columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, ordered = SentenceBook(sentences), RuleBook(rules)
        types = [pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string())]
        names = [field.split()[0] for field in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for value in batch.column(1):
                found = list(book.names(value.as_py()))
                licences, left = ordered.match([name for name, _ in found])
                rows.append((licences, [name for name, _ in found], [number for _, number in found], left))
            columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, SCHEMA)
