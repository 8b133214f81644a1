"""License scans: templates with markup, compiled to token automata, beside a list of plain phrases.

A template is wording with ``<<opt>> ... <</opt>>`` around regions that may be missing and ``<<var;max=n>>`` for regions that may be
replaced (0 to n words). It becomes an automaton over words: mandatory words are edges, an optional region is an edge around it, a
replaceable one takes any word. A text is accepted where all mandatory wording stands exactly. The automaton
starts only in texts that hold the template's longest run of mandatory words (found by hash over all words at once).

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. Whole texts are scanned.

score is 1.0 where a template is accepted, 0.5 for phrases only, else 0.0.

Defined results: null text is empty; no words give zero counts, null places and empty label strings; repeated rows are each scanned; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowwords import Words, chunks

BETWEEN = np.ones(256, bool)
BETWEEN[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = False
#: Fixed values of the query: phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Templates over the wording of public license notices, and their labels.
TEMPLATES = {
    "mit-notice": "<<opt>>is<</opt>> released under the <<opt>>terms of the<</opt>> mit license",
    "apache-2.0-notice": "licensed under the apache license version 2 0 <<opt>>the license<</opt>>",
    "gpl-3.0-notice": "licensed under the gnu general public license <<opt>>as published by the free software foundation either<</opt>> version 3 <<opt>>of the license<</opt>> <<opt>>or <<opt>>at your option<</opt>> any later version<</opt>>",
    "cc-by-nc-4.0-notice": "licensed under <<opt>>a<</opt>> <<opt>>creative commons <<var;max=4>><</opt>> cc by nc <<opt>>sa<</opt>> <<opt>>nd<</opt>> 4 0",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<opt>>the software<</opt>> to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "all-rights-reserved": "copyright <<opt>>c<</opt>> <<var;max=8>> all rights reserved",
}
_MARK = re.compile(r"<<opt>>|<</opt>>|<<var;max=(\d+)>>|[^\s<]+")


class Automaton(NamedTuple):
    """steps[s]: word hash -> states; free[s]: states from s at no word; any_[s]: states from s by any word."""

    steps: list[dict[int, list[int]]]
    free: list[list[int]]
    any_: list[list[int]]
    final: int
    anchor: tuple[str, ...]

    def closed(self, states) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def accepts_from(self, words, at: int) -> int:
        """The end of the longest match from at, or -1."""
        now, best = self.closed([0]), -1
        while now:
            if self.final in now:
                best = at
            if at >= len(words):
                break
            w = int(words[at])
            now = self.closed({t for s in now for t in (*self.steps[s].get(w, ()), *self.any_[s])})
            at += 1
        return best


def word_hash(words: list[str]) -> np.ndarray:
    return Words(pa.array([" ".join(words)]), space=BETWEEN).hashes()


def compiled(template: str) -> Automaton:
    steps, free, any_, opened = [{}], [[]], [[]], []
    run, runs = [], []

    def state() -> int:
        steps.append({}), free.append([]), any_.append([])
        return len(steps) - 1

    at = 0
    for m in _MARK.finditer(template):
        if m[0] == "<<opt>>":
            opened.append(at)
            # a state of its own, so that skipping the region doesn't also skip back into it
            free[at].append(nxt := state())
            at = nxt
        elif m[0] == "<</opt>>":
            free[at].append(nxt := state())
            free[opened.pop()].append(nxt)
            at = nxt
        elif m[1]:
            free[at].append(at := state())
            ends = [at]
            for _ in range(int(m[1])):
                any_[at].append(nxt := state())
                at = nxt
                ends.append(at)
            last = state()
            for e in ends:
                free[e].append(last)
            at = last
        else:
            steps[at].setdefault(int(word_hash([m[0]])[0]), []).append(nxt := state())
            at = nxt
            if not opened:
                run.append(m[0])
                continue
        runs.append(run)
        run = []
    runs.append(run)
    if opened:
        raise ValueError("an optional region isn't closed")
    anchor = max(runs, key=len)
    if not anchor:
        raise ValueError("a template needs mandatory words")
    return Automaton(steps, free, any_, at, tuple(anchor))


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(word_hash(p.split()), label) for p, label in phrases.items()]
        self.templates = [(a := compiled(t), word_hash(list(a.anchor)), label) for label, t in templates.items()]

    def places(self, h: np.ndarray, row: np.ndarray, want: np.ndarray) -> np.ndarray:
        """Starts of the words want in a row within one text."""
        k = len(want)
        first = np.flatnonzero(h[: max(0, len(h) - k + 1)] == want[0])
        first = first[row[first] == row[first + k - 1]]
        for i in range(1, k):
            first = first[h[first + i] == want[i]]
        return first

    def scan(self, texts: pa.Array) -> list[tuple]:
        w = Words(texts, lower=True, space=BETWEEN)
        h = w.hashes()
        n = np.diff(w.first)
        row = np.repeat(np.arange(len(n)), n)
        starts = [[] for _ in n]
        base, more = [set() for _ in n], [set() for _ in n]
        for want, label in self.phrases:
            for p in self.places(h, row, want):
                starts[row[p]].append(int(p - w.first[row[p]]))
                base[row[p]].add(label)
        for automaton, anchor, label in self.templates:
            for i in np.unique(row[self.places(h, row, anchor)]):
                own = h[w.first[i] : w.first[i + 1]]
                begin = {x for s in automaton.closed([0]) for x in automaton.steps[s]}
                if any(automaton.accepts_from(own, int(p)) >= 0 for p in np.flatnonzero(np.isin(own, np.array(list(begin), np.uint64)))):
                    more[i].add(label)
        return [(int(n[i]), len(s), min(s, default=None), max(s, default=None), ",".join(sorted(base[i])), ",".join(sorted(base[i] | more[i])), 1.0 if more[i] else 0.5 if base[i] else 0.0) for i, s in enumerate(starts)]


KIND = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())


def scan_licenses(docs: DataFrame, key: str = "doc_id", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of docs: its id, counts and places of phrases, labels and score."""
    scanner = Scanner(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)

    def scan(batches):
        for b in chunks(batches):
            columns = list(zip(*scanner.scan(b.column("text")))) or [[]] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, _TYPES))], ["doc_id", *(x.split()[0] for x in KIND.split(", "))])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), "text").mapInArrow(scan, "doc_id bigint, " + KIND)


def op10(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs)
