"""License scans with a generalised suffix automaton of licence tokens.

The words of all licence templates (whole texts in ``templates``, and the notices by which files refer to them) and phrases
make one automaton, some 90,000 states.  The templates are read on the driver and sent with the task; each worker process builds the
automaton once.  Each file is streamed through it once: after every word the state and the length of the
longest match that ends there (the matching statistics) are known.  Maximal matches of enough words are
chained, in order and without overlap in file and template, to the spans of a template that the file covers.

Defined cases: a null text is an empty text; a text without words has no labels and score 0; rows repeated give
equal rows; no rows give no rows.  Very long texts are read whole, in time linear in their words and n log n in their long
matches.  Only id and text are read, so no other column clashes.
"""

from __future__ import annotations

import heapq
import os
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship_package
from .rows import keyed_texts, map_batches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}

# Phrases whose every occurrence counts, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Passages by which files refer to a public licence, templates beside the whole texts.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by-nc": "licensed under cc by nc 4 0",
}

FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "templates")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER))


def whole_texts(folder: str = FOLDER) -> dict[str, str]:
    """Templates by name: the files ``<name>.txt`` of a folder."""
    out = {}
    for file in sorted(os.listdir(folder)):
        if file.endswith(".txt"):
            with open(os.path.join(folder, file), encoding="utf-8") as f:
                out[file[:-4]] = " ".join(words_of(f.read()))
    return out


class Automaton:
    """Generalised suffix automaton of token strings: by state its transitions, suffix link, longest length and
    the place (string, end) where it was first seen."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.place = [-1], [0], [(-1, -1)]

    def _state(self, length: int, place: tuple[int, int]) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.place.append(place)
        return len(self.next) - 1

    def _split(self, p: int, w: str, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.place[q])
        self.next[clone] = dict(self.next[q])
        self.link[clone] = self.link[q]
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, number: int, words: list[str]) -> list[int]:
        """Adds one string; returns its state after each word."""
        last, states = 0, []
        for end, w in enumerate(words, 1):
            q = self.next[last].get(w)
            if q is not None:
                if self.length[q] != self.length[last] + 1:
                    q = self._split(last, w, q)
                last = q
            else:
                new, p = self._state(self.length[last] + 1, (number, end)), last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][w]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
                last = new
            states.append(last)
        return states


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str], min_match: int) -> None:
        self.templates = {k: v.split() for k, v in templates.items()}
        self.labels, self.phrases, self.min_match = list(self.templates), {tuple(k.split()): v for k, v in phrases.items()}, min_match
        a = self.automaton = Automaton()
        for i, label in enumerate(self.labels):
            a.add(i, self.templates[label])
        for p in self.phrases:
            a.add(-1, list(p))
        # where phrases end: a match ends one if its state, or one of its suffixes, is the phrase
        self.ends: dict[int, list[tuple[int, str]]] = {}
        exact: dict[int, tuple[int, str]] = {}
        for p, label in self.phrases.items():
            state = 0
            for w in p:
                state = a.next[state][w]
            exact[state] = (len(p), label)
        for s in range(len(a.next)):
            at, found = s, []
            while at > 0:
                if at in exact:
                    found.append(exact[at])
                at = a.link[at]
            if found:
                self.ends[s] = found
        # in which templates a state's strings lie, and where each ends there first
        self.where: list[dict[int, list[int]]] = [{} for _ in a.next]
        for i, label in enumerate(self.labels):
            state = 0
            for end, w in enumerate(self.templates[label], 1):
                while w not in a.next[state]:
                    state = a.link[state]
                state = a.next[state][w]
                at = state
                while at > 0 and a.length[at] >= min_match:  # shorter ones are never looked up
                    self.where[at].setdefault(i, []).append(end)
                    at = a.link[at]

    def matches(self, words: list[str]) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
        """(where phrases start, with their labels; long matches: file end, words, state), by the matching statistics."""
        a, start = self.automaton, self.automaton.next[0]
        nxt, link, length = a.next, a.link, a.length
        hits: list[tuple[int, str]] = []
        matches: list[tuple[int, int, int]] = []  # (file end, length, state), maximal to the right
        state = size = 0
        for at, w in enumerate(words, 1):
            if not state and w not in start:  # most words are in no licence
                continue
            if (to := nxt[state].get(w)) is None:
                if size >= self.min_match:
                    matches.append((at - 1, size, state))
                while state and w not in nxt[state]:
                    state = link[state]
                    size = length[state]
                to = nxt[state].get(w, 0)
                if not to:
                    size = 0
                    state = 0
                    continue
            state, size = to, size + 1
            if state in self.ends:
                hits += [(at - n, label) for n, label in self.ends[state] if n <= size]
        if size >= self.min_match:
            matches.append((len(words), size, state))
        return hits, matches

    def scan(self, text: str) -> tuple:
        """(n_words, n_base, first, last, base labels, labels, score, spans)."""
        words = words_of(text)
        hits, matches = self.matches(words)
        by: dict[int, list[tuple[int, int, int]]] = {}
        for end, size, state in matches:
            for i, ends in self.where[state].items():
                by.setdefault(i, []).extend((end - size, e - size, size) for e in ends)
        score, labels, spans = 0.0, set(), []
        for i, found in by.items():
            chained = chain(found)
            share = sum(n for _, _, n in chained) / len(self.templates[self.labels[i]])
            score = max(score, min(1.0, share))
            if share >= 0.5:
                labels.add(self.labels[i])
                spans += [(self.labels[i], f, t, n) for f, t, n in chained]
        base = {label for _, label in hits}
        starts = [s for s, _ in hits]
        return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score, spans


def chain(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The chain of matches (file start, template start, words), in order and not overlapping in file and template, that
    covers most words.

    Matches are taken by file start; those that have ended in the file by then stand in a list by template end in which covered words
    rise too, so the best before a match is the last one there.  n log n but for the shifting of that list.
    """
    found = sorted(set(found))
    ends: list[tuple[int, int]] = []  # (template end, covered words), both rising
    owner: list[int] = []
    open_: list[tuple[int, int]] = []  # (file end, match)
    covered: list[int] = []
    back: list[int | None] = []
    for k, (f, t, n) in enumerate(found):
        while open_ and open_[0][0] <= f:
            _, j = heapq.heappop(open_)
            item = (found[j][1] + found[j][2], covered[j])
            i = bisect_left(ends, item)
            if (i and ends[i - 1][1] >= item[1]) or (i < len(ends) and ends[i][0] == item[0]):
                continue
            ends.insert(i, item)
            owner.insert(i, j)
            while i + 1 < len(ends) and ends[i + 1][1] <= item[1]:
                ends.pop(i + 1)
                owner.pop(i + 1)
            if i and ends[i - 1][0] == item[0]:
                ends.pop(i - 1)
                owner.pop(i - 1)
        at = bisect_left(ends, (t + 1, -1)) - 1
        covered.append(n + (ends[at][1] if at >= 0 else 0))
        back.append(owner[at] if at >= 0 else None)
        heapq.heappush(open_, (f + n, k))
    out, at = [], max(range(len(found)), key=lambda k: covered[k], default=None)
    while at is not None:
        out.append(found[at])
        at = back[at]
    return out[::-1]


_scanners: dict[tuple, Scanner] = {}


def scanner(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...], min_match: int) -> Scanner:
    """One scanner for each worker process and catalogue."""
    key = (templates, phrases, min_match)
    if key not in _scanners:
        _scanners[key] = Scanner(dict(templates), dict(phrases), min_match)
    return _scanners[key]


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, min_match: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` lists (label, file word, template word, words) of chained matches for each template covered
    by half or more; ``score`` is the greatest share of a template that is covered.  ``templates`` are the notices and whole texts by default.
    """
    ship_package(docs.sparkSession)
    catalogue = tuple((templates or NOTICES | whole_texts()).items()), tuple((phrases or PHRASES).items()), min_match

    span = pa.struct([("label", pa.string()), ("file_word", pa.int64()), ("template_word", pa.int64()), ("words", pa.int64())])
    types = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(span)}

    def one(b: pa.RecordBatch) -> dict:
        own = scanner(*catalogue)
        found = [own.scan(t or "") for t in b.column("text").to_pylist()]
        out = {n: [f[k] for f in found] for k, n in enumerate(types)}
        out["spans"] = [[dict(zip(("label", "file_word", "template_word", "words"), s, strict=True)) for s in spans] for spans in out["spans"]]
        return {"doc_id": b.column("doc_id")} | out

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,file_word:long,template_word:long,words:long>>"
    return map_batches(keyed_texts(docs, id_col, text_col), one, schema, types)
