"""License scan by template markup: mandatory words, optional regions and replaceable regions, as token automata.

A template is text with `[[ ... ]]` around an optional region and `{{name:m-n}}` for a replaceable region of m to n
words. It is compiled to an automaton over words; a text matches where the automaton accepts, which takes every
mandatory word, unchanged and in place. Words are those of the lower-cased text, so signs and layout do not matter.

A template may begin with such regions: they are set apart, and the automaton begins with the first mandatory word. What
is optional there asks for nothing, what is replaceable for as many words as it holds at least before that place.

Places where a template may begin are found for a whole batch of texts by the hashes of its first mandatory words; only
there the automaton runs. Besides the templates there are the base phrases, whose words must stand consecutively.

The score is 1 with any full template, otherwise less the farther the phrases found are from license wording:
1 - 0.5 ** (places of phrases), 0 without any.

Edge cases: null, empty and wordless texts have no words, labels or places and score 0; overlapping places all count;
rows that repeat an id are scanned each; a text of any length is read whole; an empty table gives an empty result;
columns with other names are not used.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import ALNUM, documents, small_batches, words_of

#: Phrases of the base scan and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Templates by label. Mandatory wording is that of the licenses' public notices.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license [[,]] version 2.0", "apache license version 2.0 [[january 2004]]"],
    "gpl-2.0": ["gnu general public license [[as published by the free software foundation]] [[either]] version 2"],
    "gpl-3.0": ["gnu general public license [[as published by the free software foundation]] [[either]] version 3", "gplv3"],
    "lgpl": ["gnu lesser general public license [[version {{version:1-2}}]]"],
    "agpl-3.0": ["gnu affero general public license [[as published by the free software foundation]] [[either]] version 3"],
    "mit": [
        "released under the [[terms of the]] mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]]",
    ],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by": ["licensed under [[a]] [[the]] cc by {{version:2-2}} [[international]] [[license]]", "creative commons attribution {{version:2-2}} [[international]] license"],
    "cc-by-nc": ["licensed under [[a]] [[the]] cc by nc {{version:2-2}} [[international]] [[license]]", "creative commons attribution noncommercial"],
    "cc-by-sa": ["licensed under [[a]] [[the]] cc by sa {{version:2-2}} [[international]] [[license]]", "creative commons attribution sharealike"],
    "cc0": ["cc0 1.0 [[universal]]"],
    "all-rights-reserved": ["copyright [[c]] {{year:1-2}} {{holder:1-8}} all rights reserved"],
}

#: Whole license texts as templates, by label. Wording is that of the public license texts.
FULL = {
    "mit-full": """[[the]] [[mit license]] [[copyright [[c]] {{year:1-4}} {{holder:1-12}}]] [[all rights reserved]]
permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
files the software to deal in the software without restriction including without limitation the rights to use copy modify
merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including
the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as
is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness
for a particular purpose and noninfringement in no event shall the {{holder:1-12}} be liable for any claim damages or
other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software
or the use or other dealings in the software""",
    "bsd-full": """[[copyright [[c]] {{year:1-4}} {{holder:1-12}}]] [[all rights reserved]]
redistribution and use in source and binary forms with or without modification are permitted provided that the following
conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and
the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of
conditions and the following disclaimer in the documentation and or other materials provided with the distribution
[[ [[3]] neither the name of {{holder:1-12}} nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission ]] this software is provided by {{holder:1-12}} as is
and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness
for a particular purpose are disclaimed in no event shall {{holder:1-12}} be liable for any direct indirect incidental
special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss
of use data or profits or business interruption however caused and on any theory of liability whether in contract strict
liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of
the possibility of such damage""",
    "isc-full": """[[isc license]] [[copyright [[c]] {{year:1-4}} {{holder:1-12}}]]
permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted
provided that the above copyright notice and this permission notice appear in all copies the software is provided as is
and {{holder:1-12}} disclaims all warranties with regard to this software including all implied warranties of
merchantability and fitness in no event shall {{holder:1-12}} be liable for any special direct indirect or consequential
damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or
other tortious action arising out of or in connection with the use or performance of this software""",
    "zlib-full": """[[copyright [[c]] {{year:1-4}} {{holder:1-12}}]]
this software is provided as is without any express or implied warranty in no event will the authors be held liable for any
damages arising from the use of this software permission is granted to anyone to use this software for any purpose
including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]]
the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use
this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]]
altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]]
this notice may not be removed or altered from any source distribution""",
    "apache-2.0-notice": """[[copyright [[c]] {{year:1-4}} {{holder:1-12}}]]
licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
you may obtain a copy of the license at {{address:4-10}} unless required by applicable law or agreed to in writing software
distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express
or implied see the license for the specific language governing permissions and limitations under the license""",
    "gpl-notice": """[[copyright [[c]] {{year:1-4}} {{holder:1-12}}]]
[[this program is]] free software [[you]] can redistribute it and or modify it under the terms of the gnu general public
license as published by the free software foundation [[either]] version {{version:1-1}} [[of the license or at your option
any later version]] this program is distributed in the hope that it will be useful but without any warranty without even
the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more
details""",
}

_WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")
_MARKUP = re.compile(r"(\[\[)|(\]\])|\{\{(\w+):(\d+)-(\d+)\}\}|([0-9a-z\u0080-\U0010ffff]+)")


def words_of_text(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


class Automaton:
    """A nondeterministic automaton over word hashes. Arcs are (word or None for any word, next state)."""

    def __init__(self, markup: str):
        self.arcs: list[list[tuple[str | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        opened: list[int] = []
        at = 0
        for m in _MARKUP.finditer(markup.lower()):
            if m[1]:
                opened.append(at)
            elif m[2]:
                self.free[opened.pop()].append(at)
            elif m[3]:
                early = []
                for k in range(int(m[5])):
                    if k >= int(m[4]):
                        early.append(at)
                    at = self._step(at, None)
                for state in early:
                    self.free[state].append(at)
            else:
                at = self._step(at, m[6])
        if opened:
            raise ValueError(f"an optional region isn't closed: {markup}")
        self.accepting = at
        head = next(i for i, arcs in enumerate(self.arcs) if len(arcs) != 1 or arcs[0][0] is None or self.free[i] or i == at)
        if head == 0:
            raise ValueError(f"a template begins with a mandatory word: {markup}")
        self.head = [self.arcs[i][0][0] for i in range(head)]

    def _step(self, at: int, word: str | None) -> int:
        self.arcs.append([])
        self.free.append([])
        self.arcs[at].append((word, len(self.arcs) - 1))
        return len(self.arcs) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def matches(self, words: list[str]) -> int:
        """How many words from the first on the shortest match takes; 0 if there is none."""
        states = self._closed({0})
        for i, word in enumerate(words):
            if self.accepting in states:
                return i
            states = self._closed({to for s in states for want, to in self.arcs[s] if want is None or want == word})
            if not states:
                return 0
        return len(words) if self.accepting in states else 0

    @property
    def longest(self) -> int:
        return len(self.arcs)


def _leading(markup: str) -> tuple[int, str]:
    """How many words a template asks for ahead of its first mandatory word, and the template from there on."""
    before = 0
    while m := re.match(r"\s*(\[\[|\{\{\w+:(\d+)-\d+\}\})", markup):
        if m[2]:
            before += int(m[2])
            markup = markup[m.end() :]
            continue
        depth, at = 1, m.end()
        while depth:
            mark = re.compile(r"\[\[|\]\]").search(markup, at)
            if not mark:
                raise ValueError(f"an optional region isn't closed: {markup}")
            depth, at = depth + (1 if mark[0] == "[[" else -1), mark.end()
        markup = markup[at:]
    return before, markup


class Scanner:
    """Base phrases and compiled templates, with the hashes of the words that begin them."""

    def __init__(self, base: dict[str, str], templates: dict[str, list[str]]):
        self.base = [(words_of_text(p), label) for p, label in base.items()]
        parts = [(*_leading(t), label) for label, each in templates.items() for t in each]
        self.templates = [(before, Automaton(rest), label) for before, rest, label in parts]
        heads = [w for w, _ in self.base] + [a.head for _, a, _ in self.templates]
        names = sorted({w for h in heads for w in h})
        hashes = next(words_of(pa.array([" ".join(names)]), ALNUM, True))[1].hash
        of = dict(zip(names, hashes, strict=True))
        self.heads = [[of[w] for w in h] for h in heads]

    def places(self, h: np.ndarray, at: np.ndarray, head: list) -> np.ndarray:
        """Where the words of head stand consecutively within one text."""
        found = np.flatnonzero(h == head[0])
        if len(found):
            found = found[found + len(head) <= at[1:][np.searchsorted(at, found, "right") - 1]]
        for k, word in enumerate(head[1:], 1):
            found = found[h[found + k] == word]
        return found

    def scan(self, column: pa.Array):
        """(row, number of words, base places by label, template labels) of every text of a column."""
        for row, words in words_of(column, ALNUM, True):
            n = len(words.at) - 1
            base = [[] for _ in range(n)]
            labels = [set() for _ in range(n)]
            for (_, label), head in zip(self.base, self.heads, strict=False):
                found = self.places(words.hash, words.at, head)
                for d, i in zip(np.searchsorted(words.at, found, "right") - 1, found, strict=True):
                    base[d].append((int(i - words.at[d]), label))
            for (before, automaton, label), head in zip(self.templates, self.heads[len(self.base) :], strict=True):
                found = self.places(words.hash, words.at, head)
                for d, i in zip(np.searchsorted(words.at, found, "right") - 1, found, strict=True):
                    if label in labels[d] or i - words.at[d] < before:
                        continue
                    stop = min(int(words.at[d + 1]), int(i) + automaton.longest)
                    text = [words.data[words.start[k] : words.end[k]].tobytes().decode("utf-8", "replace") for k in range(int(i), stop)]
                    if automaton.matches(text):
                        labels[d].add(label)
            for d in range(n):
                yield row + d, int(words.at[d + 1] - words.at[d]), base[d], labels[d]


_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scanned(batches, scanner: Scanner):
    for batch in batches:
        out = []
        for _, n, base, found in scanner.scan(batch.column(0)):
            places = [i for i, _ in base]
            base_labels = {label for _, label in base}
            score = 1.0 if found else 1 - 0.5 ** len(places)
            out.append((n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | found)), score))
        columns = list(zip(*out, strict=True)) or [[]] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = [f.split()[0] for f in _SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*batch.schema.names[1:], *names])


def license_scan(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, list[str]] = TEMPLATES | {k: [v] for k, v in FULL.items()}) -> DataFrame:
    """doc_id and the scan's columns of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    scanner = Scanner(base, templates)
    rows = docs.select(F.col("text").cast("binary").alias("text"), "doc_id")
    return rows.mapInArrow(lambda b: _scanned(b, scanner), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
