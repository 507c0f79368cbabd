"""Licence scans by template markup.

A template is a text with ``<<optional>> ... <<end>>`` regions that may be absent and ``<<any:n>>`` regions
that stand for up to n words. All templates are compiled into one automaton over words; a place in a text
matches a template where the automaton accepts it, so all mandatory words must be there, in order, exactly.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

#: Words: runs of digits, lower-case ASCII letters and anything beyond ASCII, in lower-cased UTF-8.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Phrases whose places are counted, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The wording of public licences, cut into notices that refer to a licence and whole licence texts.
_COPYRIGHT = "<<optional>> copyright <<optional>> c <<end>> <<any:16>> <<end>> <<optional>> all rights reserved <<end>>"
_BSD_CONDITIONS = """redistribution and use in source and binary forms with or without modification are permitted provided that
    the following conditions are met <<optional>> 1 <<end>> redistributions of source code must retain the above copyright notice
    this list of conditions and the following disclaimer <<optional>> 2 <<end>> redistributions in binary form must reproduce the
    above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials
    provided with the distribution"""
_BSD_DISCLAIMER = """this software is provided by <<any:12>> as is and any express or implied warranties including but not limited to the
    implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<any:16>> be
    liable for any direct indirect incidental special exemplary or consequential damages including but not limited to
    procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any
    theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out
    of the use of this software even if advised of the possibility of such damage"""
_GPL_NOTICE = """<<any:8>> is free software you can redistribute it and or modify it under the terms of the gnu {0} general public
    license as published by the free software foundation <<optional>> either <<end>> version {1} <<optional>> of the license
    <<end>> <<optional>> or at your option any later version <<end>> <<optional>> <<any:8>> is distributed in the hope that it
    will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular
    purpose see the gnu {0} general public license for more details <<optional>> you should have received a copy of the gnu {0}
    general public license along with <<any:8>> if not <<any:24>> <<end>> <<end>>"""
_GPL_NOTICE = _GPL_NOTICE.removeprefix("<<any:8>> is ")

TEMPLATES = {
    "apache-2.0": "licensed under the apache license <<optional>>version<<end>> 2.0 <<optional>>the license you may not use this file except in compliance with the license<<end>>",
    "apache-2.0-header": """licensed under the apache license version 2.0 the license you may not use this file except in compliance with
        the license you may obtain a copy of the license at <<optional>> http <<end>> <<optional>> https <<end>> www apache org
        licenses license 2.0 <<optional>> unless required by applicable law or agreed to in writing software distributed under the
        license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the
        license for the specific language governing permissions and limitations under the license <<end>>""",
    "mit-notice": "<<optional>>released<<end>> <<optional>>licensed<<end>> under the <<optional>>terms of the<<end>> mit license",
    "mit-text": f"""<<optional>> <<optional>> the <<end>> mit license <<optional>> mit <<end>> <<end>> {_COPYRIGHT} permission is hereby
        granted free of charge to any person obtaining a copy of this software and associated documentation files the software to
        deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
        sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the
        following conditions the above copyright notice and this permission notice <<optional>> including the next paragraph <<end>>
        shall be included in all copies or substantial portions of the software the software is provided as is without warranty of
        any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose
        and noninfringement in no event shall <<any:12>> be liable for any claim damages or other liability whether in an action of
        contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the
        software""",
    "isc-text": f"""<<optional>> isc license <<end>> {_COPYRIGHT} permission to use copy modify and <<optional>> or <<end>> distribute this
        software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission
        notice appear in all copies the software is provided as is and <<any:12>> disclaims all warranties with regard to this
        software including all implied warranties of merchantability and fitness in no event shall <<any:12>> be liable for any
        special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
        whether in an action of contract negligence or other tortious action arising out of or in connection with the use or
        performance of this software""",
    "0bsd-text": f"""{_COPYRIGHT} permission to use copy modify and or distribute this software for any purpose with or without fee is
        hereby granted the software is provided as is and <<any:12>> disclaims all warranties with regard to this software including
        all implied warranties of merchantability and fitness""",
    "bsd-2-clause-text": f"{_COPYRIGHT} {_BSD_CONDITIONS} {_BSD_DISCLAIMER}",
    "bsd-3-clause-text": f"""{_COPYRIGHT} {_BSD_CONDITIONS} <<optional>> 3 <<end>> neither the name of <<any:16>> nor the names of
        <<any:4>> contributors may be used to endorse or promote products derived from this software without specific prior written
        permission {_BSD_DISCLAIMER}""",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "zlib-text": f"""{_COPYRIGHT} this software is provided as is without any express or implied warranty in no event will the authors
        be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for
        any purpose including commercial applications and to alter it and redistribute it freely subject to the following
        restrictions <<optional>> 1 <<end>> the origin of this software must not be misrepresented you must not claim that you wrote
        the original software if you use this software in a product an acknowledgment in the product documentation would be
        appreciated but is not required <<optional>> 2 <<end>> altered source versions must be plainly marked as such and must not be
        misrepresented as being the original software <<optional>> 3 <<end>> this notice may not be removed or altered from any
        source distribution""",
    "gpl-2.0": "gnu general public license <<optional>>as published by the free software foundation<<end>> <<optional>>either<<end>> version 2",
    "gpl-3.0": "gnu general public license <<optional>>as published by the free software foundation<<end>> <<optional>>either<<end>> version 3",
    "gpl-2.0-notice": _GPL_NOTICE.format("", "2"),
    "gpl-3.0-notice": _GPL_NOTICE.format("", "3"),
    "lgpl-2.1-notice": _GPL_NOTICE.format("lesser", "2 1"),
    "lgpl-3.0-notice": _GPL_NOTICE.format("lesser", "3"),
    "agpl-3.0-notice": _GPL_NOTICE.format("affero", "3"),
    "lgpl": "gnu lesser general public license",
    "agpl": "gnu affero general public license",
    "cc-by-4.0": "<<optional>>licensed<<end>> under <<optional>>a creative commons<<end>> cc by 4.0",
    "cc-by-nc-4.0": "<<optional>>licensed<<end>> under <<optional>>a creative commons<<end>> cc by nc 4.0",
    "cc-by-sa-4.0": "<<optional>>licensed<<end>> under <<optional>>a creative commons<<end>> cc by sa 4.0",
    "mpl-2.0": "<<optional>>this source code form is<<end>> subject to the terms of the mozilla public license v 2.0",
    "mpl-2.0-header": """this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not
        distributed with this file you can obtain one at <<optional>> http <<end>> <<optional>> https <<end>> mozilla org mpl 2.0""",
    "spdx": "spdx license identifier <<any:4>>",
    "all-rights-reserved": "copyright <<any:12>> all rights reserved",
}


def words(text: str | None) -> list[bytes]:
    return _WORDS.findall((text or "").encode().lower())


def parsed(template: str) -> list[tuple]:
    """The markup as a list of ("word", w), ("any", n) and ("optional", list)."""
    out: list[tuple] = []
    opened = [out]
    for part in re.split(r"(<<[^>]*>>)", template.lower()):
        if part == "<<optional>>":
            inner: list[tuple] = []
            opened[-1].append(("optional", inner))
            opened.append(inner)
        elif part == "<<end>>":
            opened.pop()
            if not opened:
                raise ValueError("a region ends that did not begin")
        elif m := re.fullmatch(r"<<any:(\d+)>>", part):
            opened[-1].append(("any", int(m[1])))
        else:
            opened[-1] += [("word", w) for w in words(part)]
    if len(opened) > 1:
        raise ValueError("a region has no end")
    return out


class Automaton:
    """All templates as one automaton. States are sets of places in the templates; those met are kept as a table."""

    def __init__(self, templates: dict[str, str]):
        self.arcs: dict[int, tuple[bytes | None, int]] = {}  # place -> (word or any, next place)
        self.empty: dict[int, list[int]] = {}
        self.final: dict[int, str] = {}
        self.marks: dict[str, bytes] = {}  # a text without its template's mark cannot match
        starts, self.top = set(), 0
        for label, template in templates.items():
            tree = parsed(template)
            mandatory = [x for kind, x in tree if kind == "word"]
            if not mandatory:
                raise ValueError(f"{label} has no mandatory words")
            self.marks[label] = max(mandatory, key=len)
            starts.add(self.top)
            self.final[self._add(tree, self.top)] = label
            self.top += 1
        self.table: dict[tuple[frozenset, bytes], frozenset] = {}
        self.start = self._closed(starts)
        self.first = {self.arcs[s][0] for s in self.start if s in self.arcs}
        if None in self.first:
            raise ValueError("a template must not begin with a region that stands for any words")
        self.accepts: dict[frozenset, list[str]] = {}

    def _add(self, tree: list[tuple], at: int) -> int:
        """Arcs of a part that begins at a place; the place where it ends."""
        for kind, x in tree:
            begin = at
            if kind == "optional":
                at = self._add(x, at)
                self.empty.setdefault(begin, []).append(at)
                continue
            for w in [x] if kind == "word" else [None] * x:
                self.arcs[at] = (w, self.top + 1)
                self.top += 1
                at = self.top
            if kind == "any":
                for place in (begin, *range(at - x + 1, at)):
                    self.empty.setdefault(place, []).append(at)
        return at

    def _closed(self, states: set[int]) -> frozenset:
        todo = list(states)
        while todo:
            for b in self.empty.get(todo.pop(), ()):
                if b not in states:
                    states.add(b)
                    todo.append(b)
        return frozenset(states)

    def _step(self, states: frozenset, word: bytes) -> frozenset:
        if (known := self.table.get((states, word))) is None:
            if len(self.table) > 50_000:
                self.table.clear()
            arcs = (self.arcs[s] for s in states if s in self.arcs)
            known = self.table[states, word] = self._closed({b for w, b in arcs if w is None or w == word})
        return known

    def matches(self, text: list[bytes], at: int) -> dict[str, int]:
        """The templates that match from a word on, with the end of the longest match of each."""
        states, found = self.start, {}
        for i in range(at, len(text)):
            states = self._step(states, text[i])
            if not states:
                break
            if (labels := self.accepts.get(states)) is None:
                labels = self.accepts[states] = [self.final[s] for s in states if s in self.final]
            for label in labels:
                found[label] = i + 1
        return found


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.automaton = Automaton(templates)
        self.phrases = [(tuple(words(p)), label) for p, label in phrases.items()]
        self.marks = list({*self.automaton.marks.values(), *(max(p, key=len) for p, _ in self.phrases)})

    def scan(self, text: str | None) -> dict:
        data = (text or "").encode().lower()
        found = _WORDS.findall(data)
        base: list[tuple[int, str]] = []
        spans: list[tuple[str, int, int]] = []
        if any(m in data for m in self.marks):
            for phrase, label in self.phrases:
                n = len(phrase)
                base += [(i, label) for i, w in enumerate(found) if w == phrase[0] and tuple(found[i : i + n]) == phrase]
            ends: dict[str, int] = {}
            for i, w in enumerate(found):
                if w in self.automaton.first:
                    for label, end in self.automaton.matches(found, i).items():
                        if i >= ends.get(label, 0):
                            spans.append((label, i, end))
                            ends[label] = end
        labels = {label for _, label in base}
        return {
            "n_words": len(found),
            "n_base": len(base),
            "first_word": min((i for i, _ in base), default=None),
            "last_word": max((i for i, _ in base), default=None),
            "base_labels": ",".join(sorted(labels)),
            "labels": ",".join(sorted(labels | {x for x, _, _ in spans})),
            "score": 1.0 if spans else 0.5 if base else 0.0,
            "spans": [{"label": x, "first": i, "last": e - 1} for x, i, e in spans],
        }


FOUND = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])))])
_DDL = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, first long, last long>>"


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """The key and the columns of ``FOUND`` for every whole text: ``spans`` are the templates' matches, of one
    template never overlapping, from the left, each as long as it can be; the score is 1 with a template, 0.5
    with a phrase alone, else 0.

    A null or empty text has no words and none of them; rows that repeat, also null keys, stay as they are;
    texts of any length are scanned whole; an empty table gives an empty one. Only the key and the text are read.
    """

    def run(batches):
        scanner = Scanner(templates)
        for batch in batches:
            rows = pa.array([scanner.scan(t.as_py()) for t in batch.column(1)], FOUND)
            yield pa.RecordBatch.from_arrays([batch.column(0), *rows.flatten()], names=[key, *FOUND.names])

    return docs.select(key, F.col(text).alias(fresh("_text", docs))).mapInArrow(run, T.StructType([docs.schema[key], *T.StructType.fromDDL(_DDL).fields]))
