"""Operator 3, licence scans by template-markup matching.

A template is a licence wording with markup: ``[[ ... ]]`` encloses an optional region, ``<<a-b>>`` stands for a
replaceable region of a to b words of any kind. Each template is compiled into an automaton over words, which accepts a
run of successive words if the mandatory wording matches exactly and in full. Words are lower-cased (A-Z only) ASCII
letters and digits and everything outside ASCII. A template's longest mandatory phrase is looked for first, so that
the automaton runs only near places that can match. The score is 1 where a template is accepted, 0.5 where only a base
phrase stands, else 0.

Null and empty texts give zero counts, null positions and empty labels. Texts are scanned whole. Repeated rows give
repeated results, an empty table an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens as tk

# Phrases that are found wherever their words stand consecutively.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Licence wordings with markup.
TEMPLATES = {
    "mit-notice": "[[this <<1-3>> is]] released under [[the terms of]] the mit license",
    "apache-notice": "licensed under the apache license version 2 0 [[the license]]",
    "gpl-notice": "[[this <<1-3>> is]] licensed under the gnu [[lesser]] [[affero]] general public license version <<1-2>> [[or any later version]]",
    "cc-by-nc": "licensed under [[a]] [[the]] cc by nc 4 0 [[international]] [[license]]",
    "cc-by-sa": "licensed under [[a]] [[the]] cc by sa 4 0 [[international]] [[license]]",
    "cc-by-notice": "licensed under [[a]] [[the]] cc by 4 0 [[international]] [[license]]",
    "reserved-notice": "[[copyright]] [[c]] [[<<1-8>>]] all rights reserved",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the <<1-12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc": "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies [[the software is provided as is and <<1-12>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness]]",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[3 neither the name of <<1-16>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission]]",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

_WORD_OR_SPACE = bytes(tk.LOWER[b] if tk.ALNUM[b] else 0x20 for b in range(256))


class Automaton:
    """A non-deterministic automaton over words. State k lies before element k; epsilon edges skip optional regions."""

    def __init__(self, template: str):
        self.elements: list = []  # a word, or (least, most) of a replaceable region
        skips: list[tuple[int, int]] = []
        opened: list[int] = []
        runs, run, depth_clear = [], [], True
        for token in re.findall(r"\[\[|\]\]|<<\d+-\d+>>|[^\s\[\]<>]+", template):
            if token == "[[":
                opened.append(len(self.elements))
            elif token == "]]":
                skips.append((opened.pop(), len(self.elements)))
            elif token.startswith("<<"):
                self.elements.append(tuple(map(int, token[2:-2].split("-"))))
            else:
                self.elements.append(token.encode())
            depth_clear = not opened and not token.startswith(("[[", "]]", "<<"))
            if depth_clear:
                run.append((len(self.elements) - 1, token.encode()))
            else:
                runs, run = [*runs, run], []
        runs.append(run)
        anchor = max(runs, key=lambda r: sum(len(w) for _, w in r))
        if opened or not anchor:
            raise ValueError(f"unbalanced markup or no mandatory wording: {template!r}")
        self.anchor = b" " + b" ".join(w for _, w in anchor) + b" "
        self.skips = skips
        width = [1 if isinstance(e, bytes) else e[1] for e in self.elements[: anchor[0][0]]]
        #: How many words a match can begin before the anchor.
        self.reach = sum(width)
        self.final = len(self.elements)

    def _closed(self, states: set) -> set:
        """Follow the epsilon edges."""
        todo = list(states)
        while todo:
            at, used = todo.pop()
            more = [(to, 0) for frm, to in self.skips if at == frm and used == 0]
            if at < self.final and not isinstance(self.elements[at], bytes) and used >= self.elements[at][0]:
                more.append((at + 1, 0))
            for x in more:
                if x not in states:
                    states.add(x)
                    todo.append(x)
        return states

    def match(self, words: list, start: int) -> int:
        """The longest end of a match that begins at ``start``, or -1."""
        states, end, at = self._closed({(0, 0)}), -1, start
        while states:
            if (self.final, 0) in states:
                end = at
            if at >= len(words):
                break
            word, nxt = words[at], set()
            for state, used in states:
                if state < self.final:
                    element = self.elements[state]
                    if isinstance(element, bytes):
                        if element == word:
                            nxt.add((state + 1, 0))
                    elif used < element[1]:
                        nxt.add((state, used + 1))
            states, at = self._closed(nxt), at + 1
        return end


def _places(flat: bytes, phrase: bytes) -> list[int]:
    """Word positions of a phrase in ' word word '."""
    out, at, count, last = [], flat.find(phrase), 0, 0
    while at >= 0:
        count += flat.count(b" ", last, at)
        last = at
        out.append(count)
        at = flat.find(phrase, at + 1)
    return out


def scan(text: bytes, automata: dict[str, Automaton]) -> tuple:
    """The result row of one text, without its id."""
    words = text.translate(_WORD_OR_SPACE).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0
    flat = b" " + b" ".join(words) + b" "
    base, base_labels, accepted = [], set(), set()
    for phrase, label in PHRASES.items():
        found = _places(flat, b" " + phrase.encode() + b" ")
        if found:
            base_labels.add(label)
            base += found
    for label, automaton in automata.items():
        starts = (start for at in _places(flat, automaton.anchor) for start in range(max(0, at - automaton.reach), at + 1))
        if any(automaton.match(words, start) > start for start in starts):
            accepted.add(label)
    score = 1.0 if accepted else 0.5 if base else 0.0
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | accepted)), score


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row of places, labels and score for each row of ``docs`` (doc_id, text)."""
    wordings = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = {k: Automaton(v) for k, v in wordings.items()}
        for batch in batches:
            for part, data, offsets in tk.slices(batch):
                held, at = data.tobytes(), offsets.tolist()
                rows = [scan(held[a:b], automata) for a, b in zip(at[:-1], at[1:], strict=True)]
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    tk.batch_conf(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
