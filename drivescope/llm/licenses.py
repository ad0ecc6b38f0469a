"""License scans: phrases, and template markup compiled into token automata.

A template is text with markup: ``[[ ... ]]`` may be absent, ``{n}`` stands for up to n words of any kind (a holder's name, a
year). It compiles into a chain automaton over words; a text is accepted where all mandatory words follow each other exactly,
with nothing between them but what the markup allows. The words of a batch are numbers, and a number looked up in a sorted
array says where a template may begin; automata run from those places only, to their longest match. Of the templates accepted
at one place the longest match counts, so ``MIT-0`` behind an SPDX mark isn't taken for ``MIT``. Phrases and templates may
have any number of words, one included.

Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z as a-z. Defined results: null and empty
texts have no words, no labels and score 0; a template met twice counts once; ids may repeat or be null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from drivescope.llm import text as T
from drivescope.llm.frames import each_batch, id_and_text

WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

# Phrase -> label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# BSD up to the end of the disclaimer; the third clause stands at <3>, a text with the advertising clause fits neither form.
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source "
    "code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright "
    "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <3> this software is provided by {12} "
    "as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no "
    "event shall {12} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or "
    "services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence "
    "or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)

# Wording of public licenses and of their customary notices, with markup; whole texts up to their last word.
TEMPLATES = {
    "apache-2.0": "licensed under [[the terms of]] the apache license version 2 0 [[the license]]",
    "gpl-2.0": "licensed under [[the terms of]] the gnu general public license [[as published by the free software foundation]] [[either]] version 2",
    "gpl-3.0": "licensed under [[the terms of]] the gnu general public license [[as published by the free software foundation]] [[either]] version 3",
    "gpl-notice": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {1} of the license or at your option any later version",
    "cc-by-4.0": "licensed under [[a]] [[creative commons]] [[attribution]] cc by 4 0 [[international]] [[license]]",
    "cc-by-nc-4.0": "licensed under [[a]] [[creative commons]] [[attribution noncommercial]] cc by nc 4 0 [[international]] [[license]]",
    "cc-by-sa-4.0": "licensed under [[a]] [[creative commons]] [[attribution sharealike]] cc by sa 4 0 [[international]] [[license]]",
    "mit-notice": "released under the [[terms of the]] mit license",
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] "
        "shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not "
        "limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {12} be liable for any claim damages or other liability "
        "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ),
    "isc-text": (
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies the software is provided as is and {12} disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness in no event shall {12} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use "
        "data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ),
    "bsd-2-text": _BSD.replace("<3>", ""),
    "bsd-text": _BSD.replace("<3>", "[[3]] neither the name of {12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "lgpl-notice": "under the terms of the gnu lesser general public license [[as published by the free software foundation]] [[either]] version {1}",
    "agpl-notice": "under the terms of the gnu affero general public license [[as published by the free software foundation]] [[either]] version {1}",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "all-rights-reserved": "all rights reserved",
}

# Public identifiers that may stand behind an SPDX mark.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0",
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "Zlib",
)
TEMPLATES |= {f"spdx-{x.lower()}": "spdx license identifier " + re.sub("[^a-z0-9]+", " ", x.lower()) for x in SPDX}


@dataclass
class Automaton:
    """States 0 to n: ``words[s]`` leads from s to s + 1, ``skips[s]`` are states reached without a word, ``any`` accept any word."""

    words: list[bytes | None] = field(default_factory=list)
    skips: dict[int, list[int]] = field(default_factory=dict)
    mandatory: list[bool] = field(default_factory=list)

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skips.get(todo.pop(), ()):
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def next_words(self) -> dict[bytes, set[bytes | None]]:
        """For each first word what may follow it; None where any word or none may."""
        out: dict[bytes, set[bytes | None]] = {}
        end = len(self.words)
        for s in self.closure({0}):
            if s < end and self.words[s] is not None:
                out.setdefault(self.words[s], set()).update(None if t == end else self.words[t] for t in self.closure({s + 1}))
        return out

    def run(self, words: list[bytes]) -> tuple[bool, float, int]:
        """Whether words from the start on are accepted, the best share of mandatory words reached, and the longest match's length."""
        end, states, best, length = len(self.words), self.closure({0}), 0, 0
        for i, word in enumerate(words, 1):
            states = self.closure({s + 1 for s in states if s < end and self.words[s] in (None, word)})
            if not states:
                break
            best = max(best, *states)
            length = i if end in states else length
        return length > 0, sum(self.mandatory[:best]) / max(1, sum(self.mandatory)), length


def compile_template(markup: str) -> Automaton:
    """Automaton of a template; optional parts may nest."""
    out, opened = Automaton(), []
    for token in re.findall(r"\[\[|\]\]|\{\d+\}|[^\s\[\]{}]+", markup.lower()):
        at = len(out.words)
        if token == "[[":
            opened.append(at)
        elif token == "]]":
            out.skips.setdefault(opened.pop(), []).append(at)
        elif token[0] == "{":
            for i in range(int(token[1:-1])):
                out.skips.setdefault(at + i, []).append(at + i + 1)
                out.words.append(None)
                out.mandatory.append(False)
        else:
            out.words.append(token.encode())
            out.mandatory.append(not opened)
    return out


class Scanner:
    """Phrases and automata over the words of whole texts."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(tuple(p.encode() for p in phrase.split()), label) for phrase, label in phrases.items() if phrase.split()]
        self.automata = {label: compile_template(markup) for label, markup in templates.items()}
        self.starts: dict[bytes, list[str]] = {}
        follow: dict[bytes, set[bytes | None]] = {words[0]: set() for words, _ in self.phrases}
        for words, _ in self.phrases:
            follow[words[0]].add(words[1] if len(words) > 1 else None)
        for label, automaton in self.automata.items():
            for word, after in automaton.next_words().items():
                self.starts.setdefault(word, []).append(label)
                follow.setdefault(word, set()).update(after)
        free = [w for w, after in follow.items() if None in after]
        seconds = {w for after in follow.values() for w in after if w is not None}
        self.known, self.free, self.seconds = (np.sort(self.numbers(sorted(x))) for x in (follow, free, seconds))
        self.phrase_words = max([len(words) for words, _ in self.phrases], default=0)
        self.reach = max([self.phrase_words, *[len(a.words) for a in self.automata.values()]])

    @staticmethod
    def among(numbers: np.ndarray, h: np.ndarray) -> np.ndarray:
        if not len(numbers):
            return np.zeros(len(h), dtype=bool)
        return numbers[np.minimum(np.searchsorted(numbers, h), len(numbers) - 1)] == h

    @staticmethod
    def numbers(words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, dtype=T.U64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        return T.words_of(data, np.r_[0, np.cumsum([len(w) for w in words])], WORD_BYTES).hashes(lower=True)

    def scan(self, w: T.Words) -> list[tuple[int, list[tuple[int, str]], dict[str, float]]]:
        """(document, phrase places and labels, best share by template) for documents that hold a first word and what may follow it."""
        h = w.hashes(lower=True)
        followed = self.among(self.free, h)
        followed[:-1] |= self.among(self.seconds, h)[1:]
        hit = self.among(self.known, h) & followed
        found: dict[int, tuple[list[tuple[int, str]], dict[str, float]]] = {}
        for i in np.flatnonzero(hit).tolist():
            doc = int(np.searchsorted(w.first, i, side="right")) - 1
            stop = min(int(w.first[doc + 1]), i + self.reach)
            words = [bytes(w.data[w.starts[j] : w.ends[j]]).lower() for j in range(i, min(stop, i + max(1, self.phrase_words)))]
            places, shares = found.setdefault(doc, ([], {}))
            for phrase, label in self.phrases:
                if tuple(words[: len(phrase)]) == phrase:
                    places.append((i - int(w.first[doc]), label))
            labels = self.starts.get(words[0], ())
            if labels:
                words += [bytes(w.data[w.starts[j] : w.ends[j]]).lower() for j in range(i + len(words), stop)]
            ran = {label: self.automata[label].run(words) for label in labels}
            longest = max([length for _, _, length in ran.values()], default=0)
            for label, (accepted, share, length) in ran.items():
                won = accepted and length == longest
                shares[label] = max(shares.get(label, 0.0), 1.0 if won else min(share, 0.99))
        return [(doc, *x) for doc, x in found.items()]


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``n_words, n_base, first_word, last_word, base_labels, labels, score`` for every document.

    ``base_labels`` are those of the phrases, ``labels`` add the accepted templates; both sorted and comma-joined. ``score`` is
    1 where a template is accepted, else the largest share of a template's mandatory words that follow each other (a phrase
    counts at least 0.5), 0 without any.
    """
    given = (PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    d = id_and_text(docs, id_col, text_col)

    def run(batches):
        scanner = Scanner(*given)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            counts, rows = np.zeros(n, dtype=np.int64), [(0, None, None, "", "", 0.0)] * n
            for a, b, w in T.word_chunks(batch.column("text"), WORD_BYTES):
                counts[a:b] = w.counts()
                for doc, places, shares in scanner.scan(w):
                    base = {label for _, label in places}
                    accepted = {label for label, share in shares.items() if share == 1.0}
                    at = [p for p, _ in places]
                    rows[a + doc] = (len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | accepted)), max([*shares.values(), 0.5 * bool(base)]))
            n_base, first, last, base_labels, labels, score = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts), *[pa.array(x, type=pa.int64()) for x in (n_base, first, last)], pa.array(base_labels), pa.array(labels), pa.array(score)],
                ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

        return each_batch(one)(batches)

    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, {FIELDS}")
