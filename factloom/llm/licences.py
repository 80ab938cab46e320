"""Licence scans: texts are streamed through a suffix automaton of licence templates, and long matches are chained to the spans that templates cover.

Templates and phrases (few and short, so they go to every task) become one generalised suffix automaton over words. Each text gives matching statistics: at each word the longest string of the
automaton that ends there. Maximal matches of `least` words or more with a template are its segments; segments that follow each other in both text and template, at most `gap` words apart in
each, are chained so that the chain covers most. A chain that covers `share` of its template is a span and labels the text. A phrase labels it wherever its words stand side by side.

Outside stretches of neighbouring words that stand so in a template, no match is longer than a word, so the automaton only walks through such stretches; what they are is found in numpy for
whole batches by hashes, and the words are compared themselves before the walk. Every text is read whole; no row moves between tasks; memory is bounded by about 2 MB of text, or one text.

Words are runs of letters A-Z (lower-cased), digits and characters beyond ASCII. Null and empty texts have no words, no places and score 0. Rows are scanned one by one, repeated ones and those
without an id too; an empty table gives an empty result; further columns are not read. Of chains that cover as much the earlier one comes first; each segment is part of one chain at most.
The score is the largest share of a template that a chain covers, 1 where a phrase stands.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.automaton import SuffixAutomaton
from factloom.llm.words import Words, portions

# Phrases that label a text by themselves.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
# What licences say of themselves, and the sentences by which files name them.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
)
LEAST, GAP, SHARE = 4, 8, 0.8
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPAN = "array<struct<label:string,template:int,first_word:long,last_word:long,covered:int,share:double>>"
SCANNED = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPAN}"
_UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BETWEEN = np.ones(256, bool)  # bytes that are no part of a word
_BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

Segment = tuple[int, int, int]  # first word in the text, first word in the template, words


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(_UPPER_TO_LOWER))


def chained(segments: list[Segment], gap: int) -> list[tuple[int, int, int]]:
    """First word, last word (in the text) and covered words of chains of segments of one template, those that cover most first; each segment is in one chain at most.

    A segment follows one that begins before it in both text and template and ends at most gap words before it; where they overlap, the shared words count once."""
    segments = sorted(segments)
    covered, before = [n for _, _, n in segments], [-1] * len(segments)
    longest, back = max((n for _, _, n in segments), default=0), 0
    for j, (text, place, n) in enumerate(segments):
        while segments[back][0] + longest + gap < text:
            back += 1
        for i in range(back, j):
            t, p, m = segments[i]
            over = max(t + m - text, p + m - place, 0)
            if t < text and p < place and over < n and text - t - m <= gap and place - p - m <= gap and covered[i] + n - over > covered[j]:
                covered[j], before[j] = covered[i] + n - over, i
    out, used = [], [False] * len(segments)
    for j in sorted(range(len(segments)), key=lambda j: (-covered[j], segments[j])):
        i, words = j, 0
        if used[j]:
            continue
        while i >= 0 and not used[i]:
            used[i], start = True, i
            words, i = covered[j] - (covered[before[i]] if before[i] >= 0 else 0), before[i]
        out.append((segments[start][0], segments[j][0] + segments[j][2] - 1, words))
    return out


class Scanner:
    """Templates and phrases, ready to scan batches of texts."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], least: int, gap: int, share: float):
        self.labels, self.phrase_labels = [x for x, _ in templates], [x for x, _ in phrases]
        known: dict[str, int] = {}
        sequences = [[known.setdefault(w, len(known)) for w in words_of(text)] for _, text in (*templates, *phrases)]
        self.sizes = [len(s) for s in sequences]
        if min(self.sizes[: len(templates)], default=least) < least or min(self.sizes[len(templates) :], default=2) < 2:
            raise ValueError(f"templates have {least} words or more, phrases two or more")
        self.least, self.gap, self.share = least, gap, share
        self.automaton = SuffixAutomaton(sequences)
        # phrases that end in each state: its own, and those of the states it links to
        self.phrases: list[list[int]] = [[] for _ in self.automaton.link]
        for p in range(len(phrases)):
            self.phrases[self.automaton.whole[len(templates) + p]].append(p)
        for state in sorted(range(1, len(self.phrases)), key=self.automaton.length.__getitem__):
            self.phrases[state] = self.phrases[state] + self.phrases[self.automaton.link[state]]
        self.words = [w.encode() for w in known]
        hashes = Words(pa.array(list(known)), lower=True, space=_BETWEEN).hash
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.pairs = np.unique(np.array([a * len(known) + b for s in sequences for a, b in zip(s, s[1:], strict=False)], np.int64))

    def _numbered(self, w: Words) -> np.ndarray:
        """Number of each word, -1 where no template has it. By hash: the words are compared in _stretches."""
        at = np.searchsorted(self.hashes, w.hash)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == w.hash, self.order[at], -1) if len(self.hashes) else np.full(len(w.start), -1)

    def _stretches(self, w: Words) -> Iterator[tuple[int, int, list[int]]]:
        """Row, first word in the row and numbers of stretches of two words or more whose neighbours are neighbours in a template."""
        ids = self._numbered(w).astype(np.int64)
        joined = np.zeros(len(ids) + 1, bool)  # to the word before
        if len(ids) > 1 and len(self.pairs):
            keys = np.where((ids[:-1] >= 0) & (ids[1:] >= 0) & (w.row[:-1] == w.row[1:]), ids[:-1] * len(self.words) + ids[1:], -1)
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            joined[1:-1] = self.pairs[at] == keys
        starts = np.flatnonzero(~joined[:-1] & joined[1:])
        ends = np.flatnonzero(joined[:-1] & ~joined[1:]) + 1
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            same = [bytes(w.data[w.start[i] : w.end[i]]) == self.words[ids[i]] for i in range(a, b)]
            numbers = [int(ids[i]) if ok else -1 for i, ok in zip(range(a, b), same, strict=True)]
            yield int(w.row[a]), a - int(w.first[w.row[a]]), numbers

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[dict[int, list[Segment]]]]:
        """Of each text: its words, the places (phrase, first word), and the segments of each template."""
        w = Words(texts, lower=True, space=_BETWEEN)
        places: list[list[tuple[int, int]]] = [[] for _ in range(w.rows)]
        segments: list[dict[int, list[Segment]]] = [defaultdict(list) for _ in range(w.rows)]
        n_templates = len(self.labels)
        for row, first, numbers in self._stretches(w):
            open_: dict[tuple[int, int], list[int]] = {}  # by template and diagonal: text, template, words, last end
            for at, (size, state) in enumerate(self.automaton.statistics(numbers), first + 1):
                if size < 2:
                    continue
                # a phrase is the longest string of its state, so a match that reaches the state by a link is longer, but one in the state itself may be shorter
                places[row] += [(p, at - self.sizes[n_templates + p]) for p in self.phrases[state] if size >= self.sizes[n_templates + p]]
                if size < self.least:
                    continue
                for number, end, n in self.automaton.suffixes(size, state, self.least):
                    if number < n_templates:
                        run = open_.get((number, at - end))
                        if run and run[3] == at - 1:
                            run[2], run[3] = run[2] + 1, at
                        else:
                            if run:
                                segments[row][number].append((run[0], run[1], run[2]))
                            open_[number, at - end] = [at - n, end - n, n, at]
            for (number, _), run in open_.items():
                segments[row][number].append((run[0], run[1], run[2]))
        return w.count, places, segments

    def rows(self, ids: list, texts: pa.Array) -> list[tuple]:
        out = []
        for doc, n, places, segments in zip(ids, *self.scan(texts), strict=True):
            chains = [(a, b, words, number, words / self.sizes[number]) for number, found in segments.items() for a, b, words in chained(found, self.gap)]
            spans = sorted((a, number, b, words, part) for a, b, words, number, part in chains if part >= self.share)
            base = {self.phrase_labels[p] for p, _ in places}
            starts = [at for _, at in places]
            labels = base | {self.labels[number] for _, number, *_ in spans}
            score = 1.0 if places else max((c[4] for c in chains), default=0.0)
            made = [{"label": self.labels[number], "template": number, "first_word": a, "last_word": b, "covered": words, "share": part} for a, number, b, words, part in spans]
            out.append((doc, int(n), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, made))
        return out


def scanned(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, least: int = LEAST, gap: int = GAP, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base (places of phrases), first_word and last_word (smallest and largest start of one), base_labels, labels, score, and spans (label, template, first_word, last_word, covered words, share of the template)."""
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
    kinds.append(pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int32()), ("share", pa.float64())])))
    names = [c.split()[0] for c in SCANNED.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, least, gap, share)
        for part in portions(batches):
            rows = scanner.rows(part.column(0).to_pylist(), part.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, SCANNED)
