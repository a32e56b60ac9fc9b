"""Licence scans by matching statistics against a generalised suffix automaton.

All template texts are put into one automaton over words. A document is streamed through it: for
each word, the longest run of words ending there that stands in some template. Runs that can't be
prolonged are matches; for each template its matches are chained in order, and the part of the template
that a chain covers is the score of its span. Matches have at least four words, so only runs of
four words whose neighbours are neighbours in some template are streamed at all. Phrases that name a
licence count wherever they stand and are covered in full.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lociforge.llm.words import plain, slices, words

#: Phrases that name a licence wherever they stand.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices and opening clauses of well-known licences, in lower-case words.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions"
    ),
    "apache": (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www "
        "apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed "
        "under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later version"
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
        "public license as published by the free software foundation either version 2 1 of the license"
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer"
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at"
    ),
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Words a match has at least.
MIN_MATCH = 4
#: Part of a template that a chain has to cover to give its label.
MIN_COVERAGE = 0.7
#: Words between two matches of a chain at most, in the text and in the template.
MAX_GAP = 12


class Match(NamedTuple):
    """``size`` words from word ``at`` of the text and word ``place`` of a template."""

    at: int
    place: int
    size: int


class Chain(NamedTuple):
    label: str
    begin: int
    end: int
    coverage: float


@dataclass
class Automaton:
    """A generalised suffix automaton; each state keeps one end place of its words in each template."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    ends: list[dict[int, list[int]]] = field(default_factory=lambda: [{}])

    def _state(self, size: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.size.append(size)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, from_state: int, to: int, word: int) -> int:
        copy = self._state(self.size[from_state] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = copy
        while from_state >= 0 and self.next[from_state].get(word) == to:
            self.next[from_state][word] = copy
            from_state = self.link[from_state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        to = self.next[last].get(word)
        if to is not None:
            return to if self.size[to] == self.size[last] + 1 else self._split(last, to, word)
        made = self._state(self.size[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = made
            last = self.link[last]
        if last >= 0:
            to = self.next[last][word]
            self.link[made] = to if self.size[to] == self.size[last] + 1 else self._split(last, to, word)
        return made

    def add(self, template: list[int]) -> None:
        last = 0
        for word in template:
            last = self._extend(last, word)

    def place(self, templates: list[list[int]]) -> None:
        """Note where the words of each state end, in each template."""
        for k, template in enumerate(templates):
            state = 0
            for i, word in enumerate(template):
                state = self.next[state][word]
                up = state
                while up > 0:
                    self.ends[up].setdefault(k, []).append(i + 1)
                    up = self.link[up]

    def matches(self, run: list[int], offset: int) -> list[tuple[int, Match]]:
        """Template and match for each run of words that can't be prolonged to the right."""
        found, state, length = [], 0, 0
        for i, word in enumerate([*run, -1]):
            before, held = state, length
            while state > 0 and word not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            onward = self.next[state].get(word)
            if onward is not None:
                state, length = onward, length + 1
            if held and length <= held:
                for k, ends in self.ends[before].items():
                    found += [(k, Match(offset + i - held, end - held, held)) for end in ends]
        return found


@dataclass
class Scanner:
    vocabulary: dict[str, int]
    labels: list[str]
    templates: list[list[int]]
    automaton: Automaton
    neighbours: np.ndarray  # by two word codes; the last row and column are for other words

    def chains(self, matches: list[tuple[int, Match]]) -> list[Chain]:
        """Chains of each template from the best on, each of matches that the ones before don't overlap.

        Those that cover ``MIN_COVERAGE`` of the template; where none does, its best one.
        """
        found = []
        by_template: dict[int, list[Match]] = {}
        for k, match in matches:
            if match.size >= MIN_MATCH:
                by_template.setdefault(k, []).append(match)
        for k, own in by_template.items():
            own.sort()
            sure, rest = [], None
            # parts of the text on either side of a chain are on their own
            parts = [own]
            while parts:
                part = parts.pop()
                chain = self._best(k, part)
                if chain.coverage >= MIN_COVERAGE:
                    sure.append(chain)
                    sides = [m for m in part if m.at + m.size <= chain.begin], [m for m in part if m.at >= chain.end]
                    parts += [side for side in sides if side]
                elif rest is None or chain.coverage > rest.coverage:
                    rest = chain
            found += sure or [rest]
        return found

    def _best(self, k: int, own: list[Match]) -> Chain:
        """The chain of most words of template ``k``; of equal ones the shortest, of those the one in the middle."""
        score = [m.size for m in own]
        begin = [m.at for m in own]
        for j, b in enumerate(own):
            for i in range(j - 1, -1, -1):
                a = own[i]
                if b.at - (a.at + a.size) > MAX_GAP + len(self.templates[k]):
                    break
                gap, skip = b.at - a.at - a.size, b.place - a.place - a.size
                # overlapping matches count their new words only
                new = b.size + min(gap, skip, 0)
                if gap <= MAX_GAP and skip <= MAX_GAP and b.place > a.place and b.at > a.at and new > 0 and score[i] + new > score[j]:
                    score[j], begin[j] = score[i] + new, begin[i]
        rank = [(-s, m.at + m.size - b) for s, b, m in zip(score, begin, own)]
        least = min(rank)
        ties = [j for j, r in enumerate(rank) if r == least]
        best = ties[len(ties) // 2]
        return Chain(self.labels[k], begin[best], own[best].at + own[best].size, min(1.0, score[best] / len(self.templates[k])))


#: Bytes of ASCII letters lowered, digits kept, other ASCII made spaces; the rest stays.
WORD_BYTES = bytes(
    i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256)
)
#: Label and text of each template.
Table = tuple[tuple[str, str], ...]


@cache
def scanner(table: Table = tuple(TEMPLATES.items())) -> Scanner:
    vocabulary: dict[str, int] = {}
    for phrase in PHRASES:
        for word in phrase.split():
            vocabulary.setdefault(word, len(vocabulary))
    texts = [text.encode().translate(WORD_BYTES).decode().split() for _, text in table]
    if any(len(text) < MIN_MATCH for text in texts):
        raise ValueError(f"a template has at least {MIN_MATCH} words")
    templates = [[vocabulary.setdefault(w, len(vocabulary)) for w in text] for text in texts]
    automaton = Automaton()
    for template in templates:
        automaton.add(template)
    automaton.place(templates)
    neighbours = np.zeros((len(vocabulary) + 1, len(vocabulary) + 1), bool)
    for template in templates:
        neighbours[template[:-1], template[1:]] = True
    return Scanner(vocabulary, [label for label, _ in table], templates, automaton, neighbours)


def licence_words(texts: pa.Array) -> pa.Array:
    """The texts with their licence words parted by spaces."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return texts
    data = texts.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes().translate(WORD_BYTES)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(data))


def runs(known: np.ndarray, doc: np.ndarray, tool: Scanner) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs that can hold a match: each word and the next are neighbours in a template."""
    if len(known) < MIN_MATCH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = tool.neighbours[known[:-1], known[1:]] & (doc[:-1] == doc[1:])
    change = np.diff(np.concatenate([[0], pairs.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1) + 1
    long = end - begin >= MIN_MATCH
    return begin[long], end[long]


def scan_batch(texts: pa.Array, table: Table = tuple(TEMPLATES.items())) -> list[tuple]:
    """``n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` of each text."""
    tool = scanner(table)
    found = words(licence_words(texts))
    place = pc.index_in(found.vocabulary, value_set=pa.array(list(tool.vocabulary)))
    codes = np.asarray(pc.fill_null(place, -1), dtype=np.int64)
    known = codes[found.codes] if len(codes) else found.codes
    doc = found.owner()
    places: list[tuple[np.ndarray, str]] = []
    for phrase, label in PHRASES.items():
        ids = [tool.vocabulary[w] for w in phrase.split()]
        at = np.flatnonzero(known == ids[0])
        at = at[at + len(ids) <= found.starts[doc[at] + 1]]
        for k, word in enumerate(ids):
            at = at[known[at + k] == word]
        places.append((at, label))
    every = np.concatenate([at for at, _ in places])
    n_base = np.bincount(doc[every], minlength=len(texts))
    matches: dict[int, list[tuple[int, Match]]] = {}
    for a, b in zip(*runs(known, doc, tool)):
        d = int(doc[a])
        hits = tool.automaton.matches(known[a:b].tolist(), int(a - found.starts[d]))
        matches.setdefault(d, []).extend(hits)
    first, last, base = [None] * len(texts), [None] * len(texts), [set() for _ in range(len(texts))]
    for at, label in places:
        for d, i in zip(doc[at].tolist(), (at - found.starts[doc[at]]).tolist()):
            first[d] = i if first[d] is None else min(first[d], i)
            last[d] = i if last[d] is None else max(last[d], i)
            base[d].add(label)
    rows = []
    for d, n in enumerate(found.counts.tolist()):
        chains = [c for c in tool.chains(matches.get(d, ())) if c.coverage > 0]
        sure = [c for c in chains if c.coverage >= MIN_COVERAGE]
        labels = base[d] | {c.label for c in sure}
        score = 1.0 if n_base[d] else max((c.coverage for c in chains), default=0.0)
        spans = ",".join(f"{c.label}:{c.begin}:{c.end}" for c in sorted(sure))
        rows.append((n, int(n_base[d]), first[d], last[d], ",".join(sorted(base[d])), ",".join(sorted(labels)), score, spans))
    return rows


FIELDS = {
    "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string",
    "labels": "string", "score": "double", "spans": "string",
}


def scan(text: Column, templates: Iterable[tuple[str, str]] = tuple(TEMPLATES.items())) -> Column:
    """A struct of ``FIELDS``: the places of the phrases, the labels, the best coverage and the covered spans.

    Word numbers count from 0, span ends are exclusive. Null is the empty text: no words, no labels, score 0.
    ``templates`` are labels and texts to look for, whole licences too; several may have one label. Each text has
    at least ``MIN_MATCH`` words. A label's comma or colon would stand in the results as it is.
    """
    table = tuple((label, words) for label, words in templates)
    scanner(table)  # a wrong table fails here

    @F.arrow_udf(", ".join(f"{k} {v}" for k, v in FIELDS.items()))
    def values(texts: pa.Array) -> pa.Array:
        texts = plain(texts)
        rows = [row for a, b in slices(texts) for row in scan_batch(texts.slice(a, b - a), table)]
        types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        columns = list(zip(*rows)) or [()] * len(FIELDS)
        return pa.StructArray.from_arrays([pa.array(c, types[t]) for c, t in zip(columns, FIELDS.values())], list(FIELDS))

    return values(text)
