"""License scan with a generalised suffix automaton over license tokens.

The automaton of all templates is built once on the driver (its size follows the
templates, not the documents) and goes to the tasks with the function. A text
streams through it word by word: after each word the state and the matched
length say how many of the last words stand consecutively in some template
(matching statistics). Two things are read from that:

* short phrases (``BASE``): every place at which a whole phrase ends;
* matches of ``MIN_MATCH`` words or more that cannot be extended are hits on a
  template; hits of one template that follow one another in text and template,
  ``MAX_GAP`` words apart at most, are chained into a span. A span that covers
  ``MIN_COVER`` of its template adds the template's label.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fleetlens.llm.frames import chunks_of_bytes, texts_of, with_columns, without

MIN_MATCH, MAX_GAP, MIN_COVER = 6, 8, 0.5
AT_ONCE = 1 << 22
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

# fixed values: phrases of the contract and their labels
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# fixed values: notices as their publishers ask to put them into files
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "cc-by": """This work is licensed under the Creative Commons Attribution 4.0 International License.""",
    "cc-by-sa": """This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.""",
}


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # bytes: only A-Z change


class Automaton:
    """Generalised suffix automaton of word sequences.

    ``ends[s]`` names the templates and positions at which the strings of state s
    end. A suffix link leads to the state of the longest shorter ending.
    """

    def __init__(self, templates: list[list[bytes]]) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, words in enumerate(templates):
            last = 0
            for i, w in enumerate(words):
                last = self._add(last, w)
                self.ends[last].add((t, i))
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int, copy: int | None = None) -> int:
        self.next.append({} if copy is None else dict(self.next[copy]))
        self.link.append(-1 if copy is None else self.link[copy])
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        clone = self._state(self.length[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:  # another template has brought this string already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new


class Scanner:
    """What a worker needs: the automaton, the phrases by state, the templates' lengths and labels."""

    def __init__(self, base: dict[str, str], templates: dict[str, str]) -> None:
        self.phrases = [(words_of(p.encode()), label) for p, label in base.items()]
        self.templates = [(words_of(t.encode()), label) for label, t in templates.items()]
        sequences = [w for w, _ in self.phrases] + [w for w, _ in self.templates]
        self.auto = Automaton(sequences)
        a = self.auto
        # phrases by the state that holds the whole phrase, and by every state that ends with it
        self.at: list[list[int]] = [[] for _ in a.next]
        for s in sorted(range(1, len(a.next)), key=a.length.__getitem__):
            up = a.link[s]
            own = [t for t, (w, _) in enumerate(self.phrases) if (t, len(w) - 1) in a.ends[s] and a.length[up] < len(w) <= a.length[s]]
            self.at[s] = sorted([*own, *self.at[up]])

    def scan(self, words: list[bytes]) -> dict:
        """n_base, first and last start of a phrase, labels, spans (label, start, end, covered share)."""
        a, at = self.auto, self.at
        nxt, link, length, root = a.next, a.link, a.length, a.next[0]
        starts: list[int] = []
        labels: set[str] = set()
        hits: list[tuple[int, int, int, int]] = []  # template, its first word, the text's first word, number of words
        state = got = 0
        for i, w in enumerate(words):
            step = nxt[state].get(w) if state else root.get(w)
            if step is None:
                if got >= MIN_MATCH:
                    self._hit(hits, state, i, got)
                while state and (step := nxt[state].get(w)) is None:
                    state = link[state]
                    got = length[state]
                if step is None and (step := root.get(w)) is None:
                    got = 0
                    continue
            state, got = step, got + 1
            for p in at[state]:
                size = len(self.phrases[p][0])
                if size <= got:
                    starts.append(i - size + 1)
                    labels.add(self.phrases[p][1])
        if got >= MIN_MATCH:
            self._hit(hits, state, len(words), got)
        spans = self._chain(hits) if hits else []
        return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                "base_labels": sorted(labels), "spans": spans}

    def _hit(self, hits: list, state: int, end: int, got: int) -> None:
        first = len(self.phrases)
        hits += [(t - first, i - got + 1, end - got, got) for t, i in sorted(self.auto.ends[state]) if t >= first]

    def _chain(self, hits: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains hits by text order; each joins the chain of its template that it carries on with the smallest gap."""
        chains: dict[int, list[list]] = defaultdict(list)
        for t, own, start, n in sorted(hits, key=lambda h: (h[0], h[2], h[1])):
            best = None
            for c in chains[t]:
                gap, own_gap = start - c[2], own - c[1]
                if -n < gap <= MAX_GAP and -n < own_gap <= MAX_GAP and start + n > c[2] and own + n > c[1] and (best is None or abs(gap - own_gap) < best[0]):
                    best = (abs(gap - own_gap), c, max(0, -gap, -own_gap))
            if best:
                _, c, twice = best
                c[1], c[2], c[3] = own + n, start + n, c[3] + n - twice
            else:
                chains[t].append([start, own + n, start + n, n])
        spans = []
        for t, found in chains.items():
            words, label = self.templates[t]
            spans += [(label, c[0], c[2], min(1.0, c[3] / len(words))) for c in found if c[3] >= MIN_COVER * len(words)]
        return sorted(spans, key=lambda s: (s[1], s[0]))


SPANS = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("cover", T.DoubleType())]))
ADDED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.ArrayType(T.StringType())), T.StructField("spans", SPANS)])


def scan_licenses(docs: DataFrame, text: str = "text", base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels and spans (label, start, end, cover) to every row.

    One pass without a shuffle, each row on its own: repeated rows, ties and
    empty tables need no rule. A null text counts as empty (no words, first_word
    and last_word null). Columns named like the new ones are replaced, all
    others are kept. A text is held whole in its task, never more than
    ``AT_ONCE`` bytes of texts and one text.
    """
    docs = without(docs, *ADDED.names)
    scanner = Scanner(base, templates)
    shape = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(shape)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks_of_bytes(batch, text, AT_ONCE):
                found = [scanner.scan(words_of(t)) for t in texts_of(part.column(text).to_pylist())]
                for f in found:
                    f["spans"] = [dict(zip(("label", "start", "end", "cover"), s, strict=True)) for s in f["spans"]]
                yield with_columns(part, {n: pa.array([f[n] for f in found], k) for n, k in zip(ADDED.names, kinds, strict=True)})

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *ADDED.fields]))
