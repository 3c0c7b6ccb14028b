"""Licences in texts: matching statistics against a generalised suffix automaton, long matches chained to templates."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, column, rows_of, text_bytes, texts

# fixed values: the base phrases and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# fixed values: notices of well-known licences
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "apache-line": "licensed under the apache license version 2 0",
    "mit-line": "released under the mit license",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2 0",
}
#: Matches of so many words are chained; gaps in a chain are at most so many words; a chain that covers so much is a label.
LONG, GAP, COVERED = 4, 12, 0.6

#: Bytes that are no word become spaces; A-Z become a-z.
WORDS = bytes(32 if x <= 0x2F or 0x3A <= x <= 0x40 or 0x5B <= x <= 0x60 or 0x7B <= x <= 0x7F else x + 32 if 0x41 <= x <= 0x5A else x for x in range(256))


class Automaton:
    """Generalised suffix automaton over word numbers, with the end places of each state in each template."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, words in enumerate(templates):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].add((t, at))
        for state in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _new(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(-1 if like is None else self.link[like])
        self.len.append(length)
        self.ends.append(set())
        return len(self.len) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        clone = self._new(self.len[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if (q := self.next[last].get(word)) is not None:  # an earlier template has these words
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, word)
        state, p = self._new(self.len[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p < 0:
            self.link[state] = 0
        else:
            q = self.next[p][word]
            self.link[state] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, word)
        return state

    def statistics(self, words: list[int | None]) -> list[tuple[int, int, int]]:
        """(place, length, state) of the longest match that ends at each place; places without a match are left out."""
        out, state, n = [], 0, 0
        for at, word in enumerate(words):
            if word is None:
                state = n = 0
                continue
            while state and word not in self.next[state]:
                state = self.link[state]
                n = self.len[state]
            to = self.next[state].get(word)
            if to is not None:
                state, n = to, n + 1
                out.append((at, n, state))
        return out


def chains(matches: list[tuple[int, int, int]], gap: int = GAP) -> list[tuple[int, int, int]]:
    """(covered words, first, last word) of the best chain to end in each of the (start in text, start in template, length).

    Starts rise in both; steps are at most ``gap`` words in either. Overlaps count once.
    """
    out: list[tuple[int, int, int]] = []
    near: list[tuple[int, int, int, int]] = []  # covered, first, end in text, end in template
    for x, y, n in sorted(matches):
        found = (n, x, x + n, y + n)
        near = [c for c in near if x - c[2] <= gap]  # starts rise: what is too far now stays so
        for covered, first, x_end, y_end in near:
            over = max(0, x_end - x, y_end - y)
            if x >= x_end - over and over < n and y - y_end <= gap and x + n > x_end and y + n > y_end and covered + n - over > found[0]:
                found = (covered + n - over, first, x + n, y + n)
        near.append(found)
        out.append((found[0], found[1], x + n - 1))
    return out


def chained(matches: list[tuple[int, int, int]], gap: int = GAP) -> tuple[int, int, int]:
    """The best of :func:`chains`."""
    return max(chains(matches, gap), default=(0, -1, -1))


def apart(found: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Of (share, first, last) those that overlap no better one, in order of the text."""
    out: list[tuple[float, int, int]] = []  # kept in order and disjoint
    for x in sorted(set(found), reverse=True):
        at = bisect_left(out, x[1], key=lambda o: o[2])
        if at == len(out) or out[at][1] > x[2]:
            out.insert(at, x)
    return out


class Scanner:
    """Base places, template chains and labels of one text."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, covered: float = COVERED):
        self.names, self.covered = [*templates, *phrases], covered
        split = [t.encode().split() for t in (*templates.values(), *phrases)]
        self.number = {w: i for i, w in enumerate(sorted({w for t in split for w in t}))}
        self.size = [len(t) for t in split]
        self.automaton = Automaton([[self.number[w] for w in t] for t in split])
        self.phrase = {i: (len(split[i]), phrases[name]) for i, name in enumerate(self.names) if name in phrases}
        self.labels = [phrases.get(name, name.removesuffix("-line").removesuffix("-notice")) for name in self.names]
        a = self.automaton
        numbers = [[self.number[w] for w in t] for t in split]
        # (template, its next word or -1, end, length at most) of each place in a template where a suffix of a state ends
        self.longest: list[list[tuple[int, int, int, int]]] = [[] for _ in a.len]
        self.whole: list[list[tuple[int, str]]] = [[] for _ in a.len]  # the phrases that end wherever a state ends
        for state in sorted(range(1, len(a.len)), key=a.len.__getitem__):
            own = {self.phrase[t] for t, end in a.ends[state] if t in self.phrase and end == self.phrase[t][0] - 1}
            if a.len[state] >= LONG:
                kept = [x for x in self.longest[a.link[state]] if (x[0], x[2]) not in a.ends[state]]
                here = sorted(x for x in a.ends[state] if x[0] not in self.phrase)
                self.longest[state] = [(t, numbers[t][end + 1] if end + 1 < self.size[t] else -1, end, a.len[state]) for t, end in here] + kept
            self.whole[state] = self.whole[a.link[state]] + [x for x in own if a.len[a.link[state]] < x[0] <= a.len[state]]

    def scan(self, text: bytes) -> tuple:
        words = text.translate(WORDS).split()
        get = self.number.get
        numbers = [get(w) for w in words]
        stats = self.automaton.statistics(numbers)
        places, base, found = [], set(), {}
        longest, whole = self.longest, self.whole
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for at, n, state in stats:
            if n < 2:
                continue
            for size, label in whole[state]:
                if size > n:
                    continue
                places.append(at - size + 1)
                base.add(label)
            if n >= LONG:
                follows = numbers[at + 1] if at + 1 < len(numbers) else None
                for t, then, end, most in longest[state]:
                    if then != follows:  # this template's match stops here, whatever others do
                        size = min(n, most)
                        by_template.setdefault(t, []).append((at - size + 1, end - size + 1, size))
        best = 0.0
        for t, matches in by_template.items():
            ends = [(covered / self.size[t], first, last) for covered, first, last in chains(matches)]
            best = max(best, max(ends)[0])
            if long := [x for x in ends if x[0] >= self.covered]:
                found.setdefault(self.labels[t], []).extend(long)
        found = {label: apart(x) for label, x in found.items()}
        score = 1.0 if places else best
        spans = [f"{k}:{a}:{b + 1}" for k, of in sorted(found.items()) for _, a, b in of]
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), min(score, 1.0), spans


def op3_license(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Licences of each text; ``template_spans`` holds label:first word:last word + 1 of the covered template spans.

    Texts are read on their own, nothing is shuffled; the automaton has a state or two for each template word. A null
    or empty text has no words, no places and score 0; repeated rows are each returned.
    """
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "template_spans"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())]
    scanner = Scanner(templates)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scanner.scan(t) for t in text_bytes(batch)]
        return rows_of(names, [column(batch, "doc_id"), *map(list, zip(*rows, strict=True))], types)

    return arrow_map(texts(docs), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, template_spans array<string>", one)
