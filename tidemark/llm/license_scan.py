"""Operator 3: license texts by winnowed fingerprints and banded alignment.

Templates and documents are lists of lower-cased words. Of the hashes of two words in a row, winnowing keeps the
smallest in each two neighbours, so any three words in a row that a template and a document share give a common
fingerprint. Of templates of a dozen words all hashes count, because one other word may leave no three in a row. Whole
licenses of hundreds of words have pairs like "of the" in any number; their fingerprints are the hashes of all four words in
a row, of which a match of four fifths must have some: with a fifth of the template and a band's worth of other words in
between, its matched words can't all be in runs of three. An inverted index of the templates' fingerprints turns the documents' ones into hits (template,
diagonal); hits near each other are a candidate. A banded alignment of the template with the words around it gives
the matched words and their span. Templates are few and of known size, so the index is part of the task.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm._common import WordHashes, documents_of, window_hashes

MIN_COVERAGE = 0.8
BAND = 8
#: Templates of fewer words have all their hashes in the index; in longer ones than MANY_WORDS, which share dozens of
#: fingerprints with a match, one hit alone is no candidate.
FEW_WORDS, MANY_WORDS = 12, 60
#: Templates of so many words and more are found by four words in a row.
LONG_WORDS, LONG_RUN = 500, (0, 1, 2, 3)
#: Bound of the templates' words together, checked before the index is made.
MAX_TEMPLATE_WORDS = 1_000_000
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Template:
    """A license text; the words in ``needed`` (as they stand, in lower case) must be among the matched ones."""

    license: str
    name: str
    text: str
    needed: tuple[str, ...] = ()


# Wording of public license notices, and the words that tell them from their relatives.
TEMPLATES = (
    Template("MIT", "short", "Released under the MIT License.", ("mit",)),
    Template("MIT", "licensed", "Licensed under the MIT License.", ("mit",)),
    Template(
        "MIT",
        "grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    Template("Apache-2.0", "short", "Licensed under the Apache License, Version 2.0.", ("apache", "2")),
    Template(
        "Apache-2.0",
        "header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ("apache", "2"),
    ),
    Template("GPL-3.0", "short", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "3")),
    Template(
        "GPL-3.0",
        "header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("gnu", "3"),
    ),
    Template("CC-BY-NC-4.0", "short", "Licensed under CC BY-NC 4.0.", ("cc", "nc", "4")),
    Template("CC-BY-4.0", "long", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("attribution", "4")),
    Template("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "2")),
    Template("BSD", "clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    Template("ISC", "grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("Unlicense", "first line", "This is free and unencumbered software released into the public domain.", ("unencumbered",)),
)


#: Words that only the whole text of the license has, beside those of its relatives.
_TEXT_NEEDS = {"BSD-3-Clause": ("neither", "endorse")}


def license_texts() -> tuple[Template, ...]:
    """Whole texts of licenses, out of the files beside this module; further files are further licenses."""
    files = sorted((Path(__file__).parent / "licenses").glob("*.txt"))
    return tuple(Template(f.stem, "whole text", f.read_text(encoding="utf-8"), _TEXT_NEEDS.get(f.stem, ())) for f in files)


def words_in(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """Positions of the fingerprints: of each two neighbouring two-word hashes the smaller (the first of equal ones)."""
    n = len(hashes)
    if n < 2:
        return np.arange(n)
    left = hashes[:-1] <= hashes[1:]
    keep = np.zeros(n, bool)
    keep[:-1] |= left
    keep[1:] |= ~left
    return np.flatnonzero(keep)


def banded_alignment(template: Sequence, words: Sequence, low: int, high: int) -> list[tuple[int, int]]:
    """Matched pairs (template position, word position) of an alignment with most matches among those whose diagonals,
    word position less template position, are in low..high. Words of either may be left out anywhere at no cost.
    """
    width = high - low + 1
    if width < 1:
        return []
    scores = [[0] * (width + 1)]  # a column more, of zeros, stands for what is above the band
    for i, word in enumerate(template, 1):
        above, row = scores[-1], [0] * (width + 1)
        for d in range(max(0, 1 - i - low), width):
            j = i + low + d
            best = above[d + 1]
            if d and row[d - 1] > best:
                best = row[d - 1]
            if j <= len(words) and words[j - 1] == word and above[d] >= best:
                best = above[d] + 1
            row[d] = best
        scores.append(row)
    i = len(template)
    d = max(range(width), key=lambda x: (scores[i][x], -x))
    out = []
    while scores[i][d]:
        j, here = i + low + d, scores[i][d]
        if d and scores[i][d - 1] == here:
            d -= 1
        elif scores[i - 1][d + 1] == here:
            i, d = i - 1, d + 1
        else:
            out.append((i - 1, j - 1))
            i -= 1
    return out[::-1]


@dataclass(frozen=True)
class Match:
    template: Template
    matched: int
    coverage: float
    first: int  # word of the document
    last: int


class TemplateIndex:
    """Fingerprints of all templates, to (template, position)."""

    def __init__(self, templates: Sequence[Template] = TEMPLATES, min_coverage: float = MIN_COVERAGE, band: int = BAND):
        self.templates = [t for t in templates if words_in(t.text)]
        self.words = [words_in(t.text) for t in self.templates]
        if sum(map(len, self.words)) > MAX_TEMPLATE_WORDS:
            raise ValueError("these templates are too many words for one index")
        self.min_coverage, self.band = min_coverage, band
        hashes = WordHashes()
        # Fingerprints by how documents are looked through: winnowed pairs of words, all pairs, single words, all four words in a row.
        self.index: tuple[dict[int, list[tuple[int, int]]], ...] = ({}, {}, {}, {})
        for k, words in enumerate(self.words):
            kind = 2 if len(words) == 1 else 1 if len(words) < FEW_WORDS else 0 if len(words) < LONG_WORDS else 3
            own = hashes.array(words) if kind == 2 else window_hashes(hashes.array(words), LONG_RUN if kind == 3 else (0, 1))
            for p in (np.arange(len(own)) if kind else winnowed(own)).tolist():
                self.index[kind].setdefault(int(own[p]), []).append((k, p))
        self._tables = [np.zeros(1 << 20, bool) for _ in self.index]
        for table, found in zip(self._tables, self.index, strict=True):
            if found:
                table[np.array(list(found), np.uint64) >> np.uint64(44)] = True
        self.bags = [Counter(w) for w in self.words]

    def matches(self, words: list[str], hashes: WordHashes) -> list[Match]:
        """All matches in a document, in order of place: of overlapping ones of a license the best."""
        own = hashes.array(words)
        marks = window_hashes(own, (0, 1))
        hits: dict[int, Counter[int]] = {}
        runs = window_hashes(own, LONG_RUN) if self.index[3] else own[:0]
        for kind, (index, table, values) in enumerate(zip(self.index, self._tables, (marks, marks, own, runs), strict=True)):
            if not index or not len(values):
                continue
            spots = np.arange(len(values)) if kind else winnowed(values)
            for p in spots[table[values[spots] >> np.uint64(44)]].tolist():
                for k, at in index.get(int(values[p]), ()):
                    hits.setdefault(k, Counter())[p - at] += 1
        out: list[Match] = []
        for k, own_hits in hits.items():
            out += self._of_template(k, own_hits, words)
        # Of a license, matches that were chosen don't overlap: only the neighbours of a place need a look.
        chosen_of: dict[str, list[tuple[int, int]]] = {}
        chosen: list[Match] = []
        for m in sorted(out, key=lambda m: (-m.matched, m.last - m.first, m.first, m.template.name)):
            places = chosen_of.setdefault(m.template.license, [])
            at = bisect_left(places, (m.first, m.last))
            if (at == 0 or places[at - 1][1] < m.first) and (at == len(places) or places[at][0] > m.last):
                places.insert(at, (m.first, m.last))
                chosen.append(m)
        return sorted(chosen, key=lambda m: (m.first, m.last, m.template.license))

    def _of_template(self, k: int, diagonals: Counter[int], words: list[str]) -> list[Match]:
        own, template = self.words[k], self.templates[k]
        least = -(-len(own) * round(self.min_coverage * 1000) // 1000)
        groups: list[list[int]] = []
        for d in sorted(diagonals):
            if groups and d - groups[-1][0] <= self.band:
                groups[-1].append(d)
            else:
                groups.append([d])
        found, bag = [], self.bags[k]
        for g in groups:
            if len(own) > MANY_WORDS and sum(diagonals[d] for d in g) < 2:
                continue
            low, high = g[0] - self.band, g[-1] + self.band
            todo = [(max(0, low), min(len(words), high + len(own)))]
            while todo:  # what is left and right of a match may hold another one
                start, stop = todo.pop()
                around = words[start:stop]
                got = Counter(w for w in around if w in bag)
                if sum((got & bag).values()) < least or any(not got[w] for w in template.needed):
                    continue
                pairs = banded_alignment(own, around, low - start, high - start)
                if len(pairs) >= least and {*template.needed} <= {own[i] for i, _ in pairs}:
                    first, last = pairs[0][1] + start, pairs[-1][1] + start
                    found.append(Match(template, len(pairs), len(pairs) / len(own), first, last))
                    todo += [(start, first), (last + 1, stop)]
        return found


def _scanned(index: TemplateIndex):
    names = ["doc_id", "license", "template", "matched", "coverage", "start_char", "end_char"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for doc, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = cell.as_py()
                found = index.matches(words_in(text), hashes) if text else []
                if found:
                    # Words are counted in the text as it is: lowering may change its length, never its words.
                    spans = [m.span() for m in _WORD.finditer(text)]
                    lowered = text.lower()
                    if len(lowered) != len(text):
                        spans = _spans(text)
                    rows += [(doc, m.template.license, m.template.name, m.matched, m.coverage, spans[m.first][0], spans[m.last][1]) for m in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return run


def _spans(text: str) -> list[tuple[int, int]]:
    """Spans in text of the words of text.lower(), where that has another length."""
    place = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
    return [(place[m.start()], place[m.end() - 1] + 1) for m in _WORD.finditer(text.lower())]


def scan_licenses(docs: DataFrame, templates: Sequence[Template] | None = None, min_coverage: float = MIN_COVERAGE, band: int = BAND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each match: doc_id, license, template, matched (words), coverage (of the template), start_char, end_char.

    The templates are TEMPLATES (notices and opening paragraphs) and license_texts() (whole texts), unless given.

    Documents without a match, null and empty ones among them, give no row; an empty table gives none. Of overlapping
    matches of one license the one with most words stays, then the shortest, then the first. Matches of different
    licenses may overlap. Very long texts are scanned whole. Repeated rows are scanned each; a null doc_id stays null.
    Other columns are not read, whatever their names.
    """
    templates = (*TEMPLATES, *license_texts()) if templates is None else templates
    schema = "doc_id long, license string, template string, matched long, coverage double, start_char long, end_char long"
    return documents_of(docs, id_col, text_col).mapInArrow(_scanned(TemplateIndex(templates, min_coverage, band)), schema)
