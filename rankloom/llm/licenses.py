"""Licence scan by a generalised suffix automaton over the words of licence templates.

Every text is streamed once through the automaton, which yields its matching statistics: at each word, the length of the longest
run of words ending there that some template holds; the suffix links from there give the longest one at every place of every template.
Matches of `least` words or more that can't be made longer at their place are chained, per template, in text
and template order into spans, one for each occurrence; a span's share of the template's words is its coverage. Phrases stand among the templates, so
their places are read from the automaton's states too. Words that are in no template, and neighbours that no template has,
end a match; they are sorted out with array operations before the automaton runs.

Defined cases. Null text: the empty text: no words, places, labels; score 0. Null doc_id and repeated rows: kept, one result
each. Empty table: no rows. Very long texts: streamed whole, in time linear in their words. Templates and phrases without words never occur.
Other columns are never read.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm.textkit import ALNUM, LOWER, text_pieces, word_hashes, words

#: Phrases with the label that each place of them gives.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public licence notices, by label. Whole licences are beside them, in licence_texts.
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-or-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
_FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licence_texts")
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<template:string,first_word:long,last_word:long,covered:int,coverage:double>>"


def _plain(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


@functools.cache
def _templates() -> dict[str, str]:
    out = dict(NOTICES)
    for name in sorted(os.listdir(_FOLDER)):
        with open(os.path.join(_FOLDER, name), encoding="utf-8") as f:
            out[name.removesuffix(".txt")] = " ".join(_plain(f.read()))
    return out


TEMPLATES = _templates()


class Automaton:
    """A suffix automaton of several word sequences. Word 0 is no template's word. Runs of fewer than `least` words have no places."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str], least: int = 1) -> None:
        templates = {k: t for k, t in templates.items() if t.split()}
        phrases = {p: label for p, label in phrases.items() if p.split()}
        self.names, self.sizes = list(templates), [len(t.split()) for t in templates.values()]
        sequences = [t.split() for t in templates.values()] + [p.split() for p in phrases]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for s in sequences for w in s}))}
        self.texts = [[self.vocabulary[w] for w in t.split()] for t in templates.values()]
        self.next, self.link, self.length, self.ends = [{}], [-1], [0], [[]]
        self.width, pairs = len(self.vocabulary) + 1, set()
        for k, sequence in enumerate(sequences):
            ids, last = [self.vocabulary[w] for w in sequence], 0
            pairs.update(a * self.width + b for a, b in zip(ids, ids[1:]))
            for at, c in enumerate(ids):
                last = self._add(last, c)
                if k < len(templates):
                    self.ends[last].append((k, at + 1))
        self.pairs = np.array(sorted(pairs), np.int64)
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:  # a state's run also ends wherever a longer run of its suffix family ends
            if self.link[s] > 0 and self.length[self.link[s]] >= least:
                self.ends[self.link[s]] = sorted({*self.ends[self.link[s]], *self.ends[s]})
        self.phrases = [[] for _ in self.next]
        self.labels = list(phrases.values())
        found, self.single, heads = {}, [], set()
        for k, p in enumerate(phrases):
            ids = [self.vocabulary[w] for w in p.split()]
            if len(ids) == 1:  # needs no run
                self.single.append((ids[0], k))
                continue
            heads.add(ids[0] * self.width + ids[1])
            state = 0
            for c in ids:
                state = self.next[state][c]
            found[state, len(ids)] = k
        for s in reversed(order):
            # suffixes of a state's longest run: phrases of its own family, then its link's
            shortest = self.length[self.link[s]] + 1
            own = [(found[s, m], m) for m in range(shortest, self.length[s] + 1) if (s, m) in found] if any(x == s for x, _ in found) else []
            self.phrases[s] = own + (self.phrases[self.link[s]] if self.link[s] > 0 else [])
        self.heads = np.array(sorted(heads), np.int64)
        raw = [w.encode() for w in self.vocabulary]
        stops = np.cumsum([len(w) for w in raw]).astype(np.int64)
        hashes = word_hashes(np.frombuffer(b"".join(raw), np.uint8), stops - np.array([len(w) for w in raw], np.int64), stops)
        sort = np.argsort(hashes)
        self.hashes, self.ids = hashes[sort], np.array(list(self.vocabulary.values()), np.int32)[sort]

    def neighbours(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each two words in a row, whether some sequence has them so, and whether a phrase begins with them."""
        good, begin = np.zeros(max(len(ids) - 1, 0), bool), np.zeros(max(len(ids) - 1, 0), bool)
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        code = ids[at].astype(np.int64) * self.width + ids[at + 1]
        for out, known in ((good, self.pairs), (begin, self.heads)):
            if len(known):
                out[at] = known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code
        return good, begin

    def _add(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, c, q)
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, moves: dict, length: int, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The template word of each word, or 0."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], 0)

    def stream(self, ids: list[int]):
        """(state, length) after each word."""
        state = length = 0
        for c in ids:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            yield state, length


@functools.lru_cache(4)
def _automaton(templates: tuple, phrases: tuple, least: int) -> Automaton:
    """One for all batches of a worker."""
    return Automaton(dict(templates), dict(phrases), least)


def _outside(match: tuple[int, int, int], spans: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """The parts of a match of `least` words or more outside sorted spans."""
    at, size, start = match
    out, free = [], at
    for first, last in spans[max(0, bisect.bisect_left(spans, (at, -1)) - 1) :]:
        if first >= at + size:
            break
        if last >= at:
            out.append((free, first))
            free = max(free, last + 1)
    out.append((free, at + size))
    return [(a, b - a, start + a - at) for a, b in out if b - a >= least]


def chains(matches: list[tuple[int, int, int]], gap: int, least: int) -> list[tuple[int, int, int]]:
    """(covered words, first, last word) of chains of matches (first word, length, template start): chains go forward in text and
    template, with at most `gap` words between their matches. The chain that covers most words comes first; the others don't overlap better ones, of
    whose words they have none."""
    out, left, spans = [], sorted(matches), []
    while left:
        longest, best, back = max(size for _, size, _ in left), [], []
        zone = [bisect.bisect(spans, (at, 1 << 62)) for at, _, _ in left]
        for j, (at, size, start) in enumerate(left):
            covered, before = size, -1
            for i in range(j - 1, -1, -1):
                at_i, size_i, start_i = left[i]
                if at - at_i - longest > gap or zone[i] != zone[j]:
                    break
                over = max(0, at_i + size_i - at, start_i + size_i - start)
                if at_i < at and start_i < start and size > over and at - at_i - size_i <= gap and best[i] + size - over > covered:
                    covered, before = best[i] + size - over, i
            best.append(covered)
            back.append(before)
        used, new = set(), []
        for j in sorted(range(len(left)), key=lambda j: (-best[j], left[j])):
            path, i = [], j
            while i >= 0 and i not in used:
                path.append(i)
                i = back[i]
            if i >= 0 or not path:
                continue
            first, last = left[path[-1]][0], left[j][0] + left[j][1] - 1
            at = bisect.bisect(new, (first, last))
            if (at and new[at - 1][1] >= first) or (at < len(new) and new[at][0] <= last):
                continue
            used.update(path)
            new.insert(at, (first, last))
            out.append((best[j], first, last))
        spans = sorted(spans + new)
        left = sorted(x for j, m in enumerate(left) if j not in used for x in _outside(m, new, least))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def _scan(ids: np.ndarray, at: np.ndarray, auto: Automaton, least: int) -> tuple[dict, dict]:
    """Phrase places (phrase, first word) and maximal matches by text."""
    places, matches = defaultdict(list), defaultdict(lambda: defaultdict(list))
    for word, k in auto.single:
        for i in np.flatnonzero(ids == word).tolist():
            doc = int(np.searchsorted(at, i, "right")) - 1
            places[doc].append((k, i - int(at[doc])))
    if len(ids) < 2:
        return places, matches
    good, begin = auto.neighbours(ids)
    edge = at[1:-1] - 1
    good[edge[(edge >= 0) & (edge < len(good))]] = False  # no match goes on from one text to the next
    step = np.diff(np.concatenate([[0], good.view(np.int8), [0]]))
    begins, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + 1  # of words: begins .. stops - 1
    heads = np.concatenate([[0], np.cumsum(begin & good)])
    use = (stops - begins >= least) | (heads[stops - 1] > heads[begins])
    begins, stops = begins[use], stops[use]
    for a, b, doc in zip(begins.tolist(), stops.tolist(), (np.searchsorted(at, begins, "right") - 1).tolist()):
        base, run = a - int(at[doc]), ids[a:b].tolist()
        states = list(auto.stream(run))
        for i, (state, length) in enumerate(states):
            for k, m in auto.phrases[state]:
                if m <= length:
                    places[doc].append((k, base + i + 1 - m))
            seen = set()
            while length >= least:
                for template, end in auto.ends[state]:
                    if (template, end) not in seen:
                        seen.add((template, end))
                        words_ = auto.texts[template]
                        if i + 1 == len(run) or end == len(words_) or words_[end] != run[i + 1]:
                            matches[doc][template].append((base + i + 1 - length, length, end - length))
                state = auto.link[state]
                length = auto.length[state]
    return places, matches


def scan(docs: DataFrame, *, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, least: int = 4, gap: int = 8, coverage: float = 0.6) -> DataFrame:
    """One row per document: words, phrase places, labels (a template's own from `coverage` on), best coverage and spans."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases

    def run(batches):
        auto = _automaton(tuple(templates.items()), tuple(phrases.items()), least)
        for batch in batches:
            doc_ids, rows = batch.column("doc_id").cast(pa.int64()).to_pylist(), []
            for lo, data, offsets in text_pieces(batch.column("text")):
                data = LOWER[data]
                starts, stops, at = words(data, offsets, ALNUM)
                places, matches = _scan(auto.of(word_hashes(data, starts, stops)), at, auto, least)
                for i, n in enumerate(np.diff(at).tolist()):
                    mine, spans = places.get(i, []), []
                    for template, found in matches.get(i, {}).items():
                        spans += [{"template": auto.names[template], "first_word": first, "last_word": last, "covered": covered, "coverage": min(1.0, covered / auto.sizes[template])} for covered, first, last in chains(found, gap, least)]
                    spans.sort(key=lambda x: (-x["coverage"], x["template"], x["first_word"]))
                    base = {auto.labels[k] for k, _ in mine}
                    more = {x["template"] for x in spans if x["coverage"] >= coverage}
                    at_words = [x for _, x in mine]
                    rows.append((doc_ids[lo + i], n, len(mine), min(at_words, default=None), max(at_words, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), max((x["coverage"] for x in spans), default=0.0), spans))
            span = pa.list_(pa.struct([("template", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int32()), ("coverage", pa.float64())]))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), span]
            columns = [pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
