"""Licence scan with a generalised suffix automaton.

The words of all licence templates go into one suffix automaton. Each text is streamed through it:
at every word the automaton knows the longest run ending there that occurs in some template
(matching statistics). Runs that cannot be extended and have ``LEAST`` words or more are chained,
in order, to spans of one template; a template whose words are covered to ``COVERED`` gives its
label. The three base phrases are found as such and always keep their labels.

The automaton is as large as the templates, which are configuration, and travels with the task.
Words outside the templates' vocabulary end every match, so only runs of known words are streamed.

Defined results: null counts as empty text; texts without words have no labels, null first_word and
last_word, and score 0; repeated rows are scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as wd
from .common import table

#: Phrases and the labels they give.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Openings and notices of well-known licences, as lower-case words.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "
               "as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
#: Words of the shortest run that counts; share of a template's words that its chained runs must cover;
#: words of text that may stand between two runs of a chain.
LEAST, COVERED, GAP = 3, 0.75, 12

SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double")


class SuffixAutomaton:
    """Generalised over several sequences of integers. ``ends[state]`` lists (sequence, position after
    the last word) of every occurrence of the state's words."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for s, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                own[last].append((s, at + 1))
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            self.ends[state] += own[state]
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]
        self.ends = [sorted(set(e)) for e in self.ends]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, parent: int, word: int, target: int) -> int:
        """A copy of target that is only as long as parent and one word."""
        copy = self._state(self.length[parent] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while parent >= 0 and self.next[parent].get(word) == target:
            self.next[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: int) -> int:
        there = self.next[last].get(word)
        if there is not None:  # an earlier sequence has it
            return there if self.length[there] == self.length[last] + 1 else self._split(last, word, there)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            there = self.next[at][word]
            self.link[new] = there if self.length[there] == self.length[at] + 1 else self._split(at, word, there)
        return new

    def matches(self, run: Sequence[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(end in run, length, state) of runs of ``least`` words or more that no next word extends."""
        state = length = 0
        for at, word in enumerate(run):
            if word not in self.next[state]:
                if length >= least:
                    yield at, length, state
                while state > 0 and word not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            else:
                state = length = 0
        if length >= least:
            yield len(run), length, state


class Scanner:
    def __init__(self, base: Sequence[tuple[str, str]] = BASE, templates: Sequence[tuple[str, str]] = TEMPLATES):
        self.labels = [label for label, _ in templates]
        sequences = [t.split() for _, t in templates]
        self.base = [(phrase.split(), label) for phrase, label in base]
        vocabulary = sorted({w for s in [*sequences, *(p for p, _ in self.base)] for w in s})
        hashes = wd.words(next(wd.slices(pa.array([" ".join(vocabulary)])))[2], wd.ALNUM, wd.LOWER).hashes
        order = np.argsort(hashes)
        self.known, self.number = hashes[order], order
        number = {w: i for i, w in enumerate(vocabulary)}
        self.base = [([number[w] for w in phrase], label) for phrase, label in self.base]
        self.lengths = [len(s) for s in sequences]
        self.automaton = SuffixAutomaton([[number[w] for w in s] for s in sequences])
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word, -1 if it has none."""
        out = np.full(len(hashes), -1, np.int32)
        maybe = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
        hit = self.known[at] == hashes[maybe]
        out[maybe[hit]] = self.number[at[hit]]
        return out

    def cover(self, matches: list[tuple[int, int, int]]) -> dict[int, float]:
        """template -> greatest share of its words that a chain of matches covers. matches: (end in
        text, length, state), in the order of the text. A chain goes forward in text and template;
        words that overlap the match before count once."""
        chains: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # (end in text, in template, words covered)
        for end, length, state in matches:
            for t, there in self.automaton.ends[state]:
                best = length
                for e, p, covered in reversed(chains[t]):
                    if end - length - e > GAP:
                        break
                    fresh = min(length, end - e, there - p)
                    if fresh > 0:
                        best = max(best, covered + fresh)
                chains[t].append((end, there, best))
        return {t: max(c for _, _, c in chain) / self.lengths[t] for t, chain in chains.items()}

    def scan(self, texts: pa.Array) -> Iterator[dict]:
        for low, high, text in wd.slices(texts):
            w = wd.words(text, wd.ALNUM, wd.LOWER)
            number, doc_of = self.numbers(w.hashes), w.doc_of()
            places: dict[int, list[tuple[int, str]]] = defaultdict(list)
            for phrase, label in self.base:
                k = len(phrase)
                hit = np.ones(max(len(number) - k + 1, 0), bool)
                for j, x in enumerate(phrase):
                    hit &= number[j:len(number) - k + 1 + j] == x
                hit = np.flatnonzero(hit)
                for i in hit[doc_of[hit] == doc_of[hit + k - 1]].tolist():
                    places[doc_of[i]].append((i - w.first[doc_of[i]], label))
            # runs of known words within a document, at least LEAST long
            known = np.flatnonzero(number >= 0)
            new = np.ones(len(known), bool)
            new[1:] = (np.diff(known) > 1) | (doc_of[known[1:]] != doc_of[known[:-1]])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(known)))
            matches: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
            for s, size in zip(starts[sizes >= LEAST].tolist(), sizes[sizes >= LEAST].tolist()):
                at = int(known[s])
                for end, length, state in self.automaton.matches(number[at:at + size].tolist(), LEAST):
                    matches[doc_of[at]].append((at + end, length, state))
            n = np.diff(w.first)
            for d in range(high - low):
                covered = self.cover(matches[d]) if d in matches else {}
                own = sorted(places[d]) if d in places else []
                base = {label for _, label in own}
                found = {self.labels[t] for t, c in covered.items() if c >= COVERED}
                yield {"n_words": int(n[d]), "n_base": len(own), "first_word": int(own[0][0]) if own else None,
                       "last_word": int(own[-1][0]) if own else None, "base_labels": ",".join(sorted(base)),
                       "labels": ",".join(sorted(base | found)),
                       "score": 1.0 if base else float(max(covered.values(), default=0.0))}


def scan(docs: DataFrame, base: Sequence[tuple[str, str]] = BASE, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per row of docs (doc_id, text). score: 1 where a base phrase stands, else the greatest
    share of a template that is covered."""
    scanner = Scanner(base, templates)

    def rows(batches):
        for b in batches:
            found = list(scanner.scan(b.column(1)))
            columns = {c: [r[c] for r in found] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, k) for v, k in zip(columns.values(), kinds))], ["doc_id", *columns])

    return docs.select("doc_id", "text").mapInArrow(rows, SCHEMA)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
