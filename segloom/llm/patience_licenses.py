"""License scans by patience alignment.

Around each place where a template's rarest word stands in a document, a window is aligned with the template: words unique to
both are anchors, the longest increasing subsequence of their places is kept, and the gaps between are aligned in the same
way; equal words at a gap's ends are matched, too. Coverage is the part of the template's words that are matched, density the
part of the text's words between the first and the last match that are. A match has at least min_coverage and min_density.

Before any alignment, a template whose words are not in the document to at least min_coverage is left out, which loses nothing.
Words: A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Null and empty texts have no words and no matches; a text can hold
several licenses, and one more than once. One pass without a shuffle; the templates are a list on the driver, of at most
MOST_WORDS words. Repeated rows and null doc_ids are rows of their own. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ALNUM, rows_out, table, text_bytes

MOST_WORDS = 1_000_000
#: Notices by which public licenses are usually stated.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[k], ends[k] = v, i
    out = []
    i = ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), rising in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, l = todo.pop()
        while i < j and k < l and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < l and a[j - 1] == b[l - 1]:
            j, l = j - 1, l - 1
            out.append((j, l))
        if i == j or k == l:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:l])
        place = {w: q for q, w in enumerate(b[k:l], k) if in_b[w] == 1}
        both = [(p, place[a[p]]) for p in range(i, j) if in_a[a[p]] == 1 and a[p] in place]
        both = [both[x] for x in increasing([q for _, q in both])]
        p0, q0 = i, k
        for p, q in both:
            todo.append((p0, p, q0, q))
            out.append((p, q))
            p0, q0 = p + 1, q + 1
        if both:
            todo.append((p0, j, q0, l))
    return sorted(out)


class Scanner:
    """Finds templates in a document's words."""

    def __init__(self, templates: dict[str, str], min_coverage: float, min_density: float):
        self.templates = {name: ws for name, text in templates.items() if (ws := words(text.encode()))}
        if sum(map(len, self.templates.values())) > MOST_WORDS:
            raise ValueError(f"more than {MOST_WORDS} words of templates")
        self.vocabulary = {w for ws in self.templates.values() for w in ws}
        self.min_coverage, self.min_density = min_coverage, min_density

    def scan(self, text: list[bytes]) -> list[tuple[str, int, int, float, float]]:
        """(template, first, last word, coverage, density) in order of name and place."""
        there = self.vocabulary.intersection(text)
        found, places = [], None
        for name, t in self.templates.items():
            if sum(w in there for w in t) < self.min_coverage * len(t):
                continue
            if places is None:
                places = {w: [] for w in there}
                for i, w in enumerate(text):
                    if w in places:
                        places[w].append(i)
            # A match may lack some of the words: the rarest that can't all be missing together are looked at.
            missing = len(t) - math.ceil(self.min_coverage * len(t) - 1e-9) + 1
            by_rarity = sorted(dict.fromkeys(w for w in t if w in there), key=lambda w: (len(places[w]), w))
            starts = sorted({i for w in by_rarity[:missing] for i in places[w]})
            reach, end = int(len(t) / self.min_density) + 1, -1
            for i in starts:
                if i < end:
                    continue
                low = max(end, i - reach, 0)
                hit = self._best(name, t, text, low, min(len(text), i + reach))
                if not hit:  # two copies in the window leave no unique words: one template's reach, where the word's places put it
                    for q in (q for q, w in enumerate(t) if w == text[i]):
                        if hit := self._best(name, t, text, max(end, i - q, 0), min(len(text), i - q + len(t))):
                            break
                if hit:
                    found.append(hit)
                    end = hit[2]
        return sorted(found)

    def _best(self, name: str, t: list[bytes], text: list[bytes], low: int, high: int) -> tuple | None:
        pairs = align(text[low:high], t)
        while pairs:
            first, last = pairs[0][0], pairs[-1][0] + 1
            coverage, density = len(pairs) / len(t), len(pairs) / (last - first)
            if coverage < self.min_coverage:
                return None
            if density >= self.min_density:
                return name, low + first, low + last, coverage, density
            # Too sparse: let go of the end word that stands farther off.
            if len(pairs) < 2:
                return None
            pairs = pairs[1:] if pairs[1][0] - pairs[0][0] > pairs[-1][0] - pairs[-2][0] else pairs[:-1]
        return None


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = 0.8, min_density: float = 0.6) -> DataFrame:
    """doc_id, n_words, n_found, license (of the most matched words; ties by name), coverage, found (array of name, first, last, coverage, density)."""
    scanner = Scanner(templates or TEMPLATES, min_coverage, min_density)
    hit = pa.struct([("name", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64()), ("density", pa.float64())])
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_found", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("found", pa.list_(hit))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text"))):
                ws = words(text)
                found = scanner.scan(ws)
                best = min(found, key=lambda f: (-round(f[3] * len(scanner.templates[f[0]])), f[0]), default=None)
                rows.append((doc_id, len(ws), len(found), best and best[0], best and best[3], [dict(zip(("name", "first", "last", "coverage", "density"), f)) for f in found]))
            yield from rows_out(out, rows, 1 << 20)

    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return base.mapInArrow(scan, "doc_id long, n_words long, n_found long, license string, coverage double, found array<struct<name: string, first: long, last: long, coverage: double, density: double>>")


def op10_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
