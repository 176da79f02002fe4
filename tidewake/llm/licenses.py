"""License scan: template markup compiled into token automata.

A template is a line of words with two kinds of regions: ``[[words]]`` may be
missing, ``{{low-high}}`` stands for that many free words, and ``(a|b)``
for either word. The compiler turns it into a token automaton; a text is
accepted at a place if the automaton reaches its end from there, so all
mandatory wording matches word for word and to the end: a licence with altered,
added or missing terms inside is not accepted. Automata start only where the
template's first words stand, which a substring search over the word sequence
finds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import payloads, slices

#: Phrases that are found as they stand, with their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Wording of published licences, whole texts first.

_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_LIABLE = "be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_USE = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
_FEE = (
    "the software is provided as is and {{1-6}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
    " in no event shall {{1-6}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"
    " whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    " [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    " [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_END = (
    "this software is provided by {{1-16}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
    " in no event shall {{1-16}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"
    " loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise"
    " arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_ENDORSE = "be used to endorse or promote products derived from this software without specific prior written permission"

#: Whole licences and standard notices, each to its end.
LICENCES = (
    ("0bsd", f"{_USE} {_FEE}"),
    (
        "apache-2.0-notice",
        "licensed under the apache license version 2 0 the license you may not use {{1-4}} except in compliance with the license you may obtain a copy of the license at {{1-9}}"
        " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
        " without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    ("bsd-2-clause", f"{_BSD} {_BSD_END}"),
    ("bsd-3-clause", f"{_BSD} [[3]] neither the (name|names) of {{{{1-40}}}} nor the names of {{{{1-6}}}} contributors may {_ENDORSE} {_BSD_END}"),
    ("bsd-3-clause", f"{_BSD} [[3]] the (name|names) of {{{{1-40}}}} may not {_ENDORSE} {_BSD_END}"),
    (
        "gpl-or-later",
        "is free software you can redistribute it and or modify it under the terms of the gnu [[(lesser|affero)]] general public license as published by the free software foundation"
        " either version (2|3) [[(0|1)]] of the license or at your option any later version",
    ),
    (
        "bsl-1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software"
        " to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"
        " the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part"
        " and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement"
        " in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise"
        " arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("isc", f"{_USE} provided that the above copyright notice and this permission notice appear in all copies {_FEE}"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of {{1-8}} and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
        " and to permit persons to whom the software is furnished to do so subject to the following conditions"
        " the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software"
        f" {_AS_IS} in no event shall {{{{1-12}}}} {_LIABLE}",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain"
        " anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"
        " in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"
        " we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"
        " we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"
        f" {_AS_IS} in no event shall the authors {_LIABLE}",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"
        " permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
        " [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software"
        " if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"
        " [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software"
        " [[3]] this notice may not be removed or altered from any source distribution",
    ),
)

#: Names by which texts refer to a licence.
REFERENCES = (
    ("agpl-3.0", "gnu affero general public license [[as published by the free software foundation]] [[either]] (version|v3|v) [[3]]"),
    ("apache-2.0", "apache license [[version]] 2 0"),
    ("cc-by-4.0", "cc by [[version]] 4 0"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nc-4.0", "cc by nc [[version]] 4 0"),
    ("cc-by-nd", "cc by [[nc]] nd"),
    ("cc-by-sa", "cc by [[nc]] sa"),
    ("cc-by-sa-4.0", "cc by sa [[version]] 4 0"),
    ("cc-by-4.0", "creative commons attribution [[4 0]] [[international]] (license|licence) [[version]] 4 0"),
    ("cc-by-4.0", "creative commons attribution 4 0 [[international]] [[public]] (license|licence)"),
    ("cc0-1.0", "cc0 1 0 [[universal]]"),
    ("gpl-2.0", "gnu general public license [[as published by the free software foundation]] [[either]] (version|v) 2"),
    ("gpl-3.0", "gnu general public license [[as published by the free software foundation]] [[either]] (version|v) 3"),
    ("gpl-2.0", "gnu general public license v2"),
    ("gpl-3.0", "gnu general public license v3"),
    ("lgpl", "gnu (lesser|library) general public license"),
    ("mit-named", "(released|licensed|distributed) under the [[terms of the]] mit license"),
    ("mpl-2.0", "mozilla public license [[version]] [[v]] 2 0"),
    ("reserved", "copyright {{1-16}} all rights reserved"),
    ("spdx", "spdx license identifier (0bsd|agpl|apache|bsd|cc|cc0|gpl|isc|lgpl|mit|mpl|unlicense|zlib)"),
)

#: Identifiers that a text may state, by the rule spdx-<identifier>.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only",
    "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
IDENTIFIERS = tuple((f"spdx-{x.lower()}", "spdx license identifier " + re.sub("[^a-z0-9]+", " ", x.lower())) for x in SPDX)

#: Whole terms of published licences, as they stand in texts/: label, file, first and last words.
WHOLE = (
    ("apache-2.0-text", "Apache-2.0", "terms and conditions for use reproduction and distribution", "end of terms and conditions"),
    ("gpl-2.0-text", "GPL-2", "terms and conditions for copying distribution and modification", "end of terms and conditions"),
    ("gpl-3.0-text", "GPL-3", "terms and conditions 0 definitions", "end of terms and conditions"),
    ("lgpl-2.1-text", "LGPL-2.1", "terms and conditions for copying distribution and modification", "end of terms and conditions"),
    ("lgpl-3.0-text", "LGPL-3", "this version of the gnu lesser general public license incorporates", "permanent authorization for you to choose that version for the library"),
    ("mpl-2.0-text", "MPL-2.0", "1 definitions 1 1 contributor", "you may add additional accurate notices of copyright ownership"),
)

_CLASSES = bytes(c if c >= 0x80 or chr(c).isdigit() else ord(chr(c).lower()) if chr(c).isalpha() else 0x20 for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words of ASCII letters (A-Z lowered), digits and bytes from 0x80 on."""
    return text.translate(_CLASSES).split()


def published(file: str) -> bytes:
    """A licence's text as it was published."""
    return resources.files(__package__).joinpath(f"texts/{file}.txt").read_bytes()


def whole_terms(file: str, first: str, last: str) -> str:
    """The words of a published text from the last place of ``first`` up to the end of ``last``."""
    words = " " + b" ".join(tokens(published(file))).decode() + " "
    begin = words.rindex(f" {first} ")
    return words[begin : words.index(f" {last} ", begin) + len(last) + 1].strip()


TEMPLATES = LICENCES + REFERENCES + IDENTIFIERS + tuple((label, whole_terms(*where)) for label, *where in WHOLE)


@dataclass(frozen=True)
class Automaton:
    """States are numbers; ``steps[s]`` maps a word (None: any) to the next states, ``skips[s]`` lists free moves."""

    label: str
    anchors: tuple[bytes, ...]
    steps: tuple[tuple[tuple[bytes | None, int], ...], ...]
    skips: tuple[tuple[int, ...], ...]

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts(self, words: list[bytes], at: int) -> bool:
        """Whether the automaton's end is reached on the words from ``at`` on."""
        end, states = len(self.steps) - 1, self._closed({0})
        while end not in states:
            if not states or at >= len(words):
                return False
            word = words[at]
            states = self._closed({to for s in states for want, to in self.steps[s] if want is None or want == word})
            at += 1
        return True


_MARKUP = re.compile(r"\[\[|\]\]|\{\{(\d+)-(\d+)\}\}|\(([^)]*)\)|[^\s\[\](){}]+")


def compile_template(label: str, template: str) -> Automaton:
    steps: list[list] = [[]]
    skips: list[list] = [[]]
    opened: list[int] = []
    lead: list[tuple[str, ...]] = []
    leading = True

    def new() -> int:
        steps.append([])
        skips.append([])
        return len(steps) - 1

    for m in _MARKUP.finditer(template):
        here = len(steps) - 1
        if m[0] == "[[":
            leading = False
            opened.append(here)
        elif m[0] == "]]":
            to = new()
            skips[here].append(to)
            skips[opened.pop()].append(to)
        elif m[1]:
            leading = False
            low, high = int(m[1]), int(m[2])
            chain = [here, *(new() for _ in range(high))]
            end = new()
            for k, s in enumerate(chain):
                if k < high:
                    steps[s].append((None, chain[k + 1]))
                if k >= low:
                    skips[s].append(end)
        else:
            choices = tuple(m[3].split("|")) if m[3] else (m[0],)
            to = new()
            steps[here] += [(w.encode(), to) for w in choices]
            if leading:
                lead.append(choices)
    starts = [""]
    for choices in lead:
        starts = [f"{s} {w}" for s in starts for w in choices]
    return Automaton(label, tuple(f"{s} ".encode() for s in starts), tuple(map(tuple, steps)), tuple(map(tuple, skips)))


def as_regex(template: str) -> str:
    """The template as a pattern over words that each stand between two blanks of their own."""
    out = ""
    for m in _MARKUP.finditer(template):
        if m[0] == "[[":
            out += "(?:"
        elif m[0] == "]]":
            out += ")?"
        elif m[1]:
            out += f"(?: [^ ]+ ){{{m[1]},{m[2]}}}"
        else:
            out += f" (?:{m[3]}) " if m[3] else f" {m[0]} "
    return out


def _places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Word numbers at which the phrase (blank-framed) stands in the blank-framed word sequence."""
    at, seen, count = joined.find(phrase), 0, 0
    while at >= 0:
        count += joined.count(b" ", seen, at)
        seen = at
        yield count
        at = joined.find(phrase, at + 1)


def scan(text: bytes, base: tuple, automata: tuple[Automaton, ...]) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, labels, score) of one text."""
    words = tokens(text)
    joined = b" " + b" ".join(words) + b" "
    places, named = [], set()
    for phrase, label in base:
        found = list(_places(joined, b" %s " % phrase.encode()))
        places += found
        if found:
            named.add(label)
    accepted = {a.label for a in automata if any(a.accepts(words, at) for anchor in a.anchors for at in _places(joined, anchor))}
    score = 1 - 0.6 ** len(named) * 0.4 ** len(accepted)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(named)), ",".join(sorted(named | accepted)), score


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    Null and empty texts have no words, no places (null ``first_word``) and
    empty labels with score 0; repeated rows are scanned one by one; an empty
    table gives no row; other columns are ignored. Texts of any length are
    scanned whole, with memory in proportion to the text. ``score`` is 1 - 0.6^(base labels) * 0.4^(accepted
    template labels).
    """
    automata = tuple(compile_template(*t) for t in templates)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [scan(x, base, automata) for x in payloads(batch.column(1))]
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
