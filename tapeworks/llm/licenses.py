"""License scans by patience alignment of notices with texts.

Words that occur once in a notice vote for where the notice would start in the text; enough votes for about the same
start open a window. Window and notice are aligned by patience: words unique to both are anchors, their longest
increasing subsequence is kept, and the gaps between kept anchors are aligned in the same way. Coverage is the aligned
share of the notice. The notices (short ones, and whole texts of short licenses) are a parameter of bounded size; a
text's windows are found from its whole length.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.license_texts import TEXTS
from tapeworks.llm.textblock import Words, blocks

_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_2 = f"{_BSD}: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = f"{_BSD_2} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def _gnu(kind: str, version: str, things: tuple[str, ...] = ("program",)) -> tuple[str, ...]:
    name = f"the GNU {kind} License"
    return (f"This work is licensed under {name}, version {version}", *(f"This {x} is free software: you can redistribute it and/or modify it under the terms of {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version" for x in things))


#: Usual notices of common licenses. A name without a version stands for notices that do not tell it.
NOTICES = {
    "all-rights-reserved": ("All rights reserved",),
    "apache-1.1": ("Licensed under the Apache License, Version 1.1",),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    "bsd": (_BSD,), "bsd-2-clause": (_BSD_2,), "bsd-3-clause": (_BSD_3,),
    **{f"cc-{k}-{v}": (f"Licensed under CC {k.upper()} {v}", f"This work is licensed under a Creative Commons {n} {v} {'International' if v == '4.0' else 'Unported' if v == '3.0' else 'Generic'} License") for k, n in _CC.items() for v in ("2.0", "2.5", "3.0", "4.0")},
    "cc0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",),
    "epl-1.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",), "epl-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",), "gpl-2.0": _gnu("General Public", "2"), "gpl-3.0": _gnu("General Public", "3"),
    "agpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",), "agpl-3.0": _gnu("Affero General Public", "3"),
    "lgpl": tuple(f"This {x} is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License" for x in ("library", "program")),
    "lgpl-2.1": _gnu("Lesser General Public", "2.1", ("library", "program")), "lgpl-3.0": _gnu("Lesser General Public", "3", ("library", "program")),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "mit": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "mpl-1.1": ("The contents of this file are subject to the Mozilla Public License Version 1.1",), "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
}

#: Notices and whole texts: what a scan looks for.
BOOK = {name: (*NOTICES.get(name, ()), *((TEXTS[name],) if name in TEXTS else ())) for name in sorted(NOTICES.keys() | TEXTS.keys())}

_SIGN = np.zeros(256, bool)
_SIGN[33:48] = _SIGN[58:65] = _SIGN[91:97] = _SIGN[123:127] = True


class BareWords(Words):
    """Lower-case words without the signs around them; words of signs alone are left out."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        super().__init__(raw, offs, lower=True)
        sign = _SIGN[self.raw] & self.inside
        solid = np.concatenate(([0], np.cumsum(self.inside & ~sign)))
        has = solid[self.ends] > solid[self.starts]
        spots = np.flatnonzero(self.inside & ~sign)
        starts, ends = self.starts[has], self.ends[has]
        self.starts, self.ends = (spots[solid[starts]], spots[solid[ends] - 1] + 1) if len(starts) else (starts, ends)
        edge = np.zeros(len(raw) + 1, np.int8)
        edge[self.starts] += 1
        edge[self.ends] -= 1
        self.inside = np.cumsum(edge[:-1]) > 0
        self.first = np.searchsorted(self.starts, offs)


def word_hashes(text: str) -> list[int]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return BareWords(raw, np.array([0, len(raw)])).hashes().tolist()


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(text: list[int], notice: list[int]) -> list[tuple[int, int]]:
    """Aligned (text, notice) positions, in order."""
    out: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(notice))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == notice[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == notice[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        left, right = Counter(text[a:b]), Counter(notice[c:d])
        where = {w: i for i, w in enumerate(text[a:b], a) if left[w] == 1}
        common = [(where[w], j) for j, w in enumerate(notice[c:d], c) if right[w] == 1 and w in where]
        kept = [common[i] for i in longest_increasing([i for i, _ in common])]
        if not kept:
            continue
        out += kept
        for (p, q), (r, s) in zip([(a - 1, c - 1), *kept], [*kept, (b, d)], strict=True):
            work.append((p + 1, r, q + 1, s))
    return sorted(out)


def scan_words(words: list[int], votes: list[tuple[int, int]], notice: list[int], least: float, telling: frozenset[int] = frozenset()) -> list[tuple[int, int, int]]:
    """(aligned words, first word, end word) of each place where the notice stands with all its telling positions;
    votes: (start, position in notice)."""
    m = len(notice)
    slack = max(1, m // 4)
    singles = sum(1 for c in Counter(notice).values() if c == 1)
    found, at = [], 0
    votes = sorted(votes)
    while at < len(votes):
        to = at + 1
        while to < len(votes) and votes[to][0] - votes[to - 1][0] <= slack:
            to += 1
        if len({j for _, j in votes[at:to]}) >= (2 * least - 1) * singles:
            lo, hi = max(0, votes[at][0] - slack), min(len(words), votes[to - 1][0] + m + slack)
            pairs = patience(words[lo:hi], notice)
            if pairs and len(pairs) >= least * m and telling <= {j for _, j in pairs}:
                found.append((len(pairs), lo + pairs[0][0], lo + pairs[-1][0] + 1))
        at = to
    return found


def telling_positions(book: list[tuple[str, list[int]]], least: float) -> list[frozenset[int]]:
    """By notice: positions of the words without which another license's notice would pass for it."""
    out = []
    for name, mine in book:
        own: set[int] = set()
        for other, theirs in book:
            if other != name:
                left = set(range(len(mine))) - {j for _, j in patience(theirs, mine)}
                if len(mine) - len(left) >= least * len(mine):
                    own |= left
        out.append(frozenset(own))
    return out


def best_places(found: list[tuple]) -> list[tuple]:
    """Of overlapping places (aligned words, coverage, name, first, end, length of notice) the one with the most aligned words."""
    kept: list[tuple] = []
    for x in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3])):
        if all(x[4] <= y[3] or y[4] <= x[3] for y in kept):
            kept.append(x)
    return kept


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, tuple[str, ...]] | None = None, least: float = 0.85) -> DataFrame:
    """One row per row of docs: id, license, coverage, first_word, end_word of its best notice (highest coverage, then
    the longest, then by name), licenses (all names found, sorted) and n_notices; null and 0 where there is none. Words
    that tell a notice from another license's must be aligned; of overlapping places only the best counts.

    The book holds notices and, for the short licenses, whole texts; a text of which less than `least` stands counts by
    its notice alone. A null or empty text has no notice. A very long text is scanned whole, with one alignment for each
    place that enough words vote for; notices that tie are ranked by length, name and place. Repeated rows get equal
    results; an empty table gives an empty table; other columns play no part.
    """
    book = [(name, word_hashes(text)) for name, texts in sorted((notices or BOOK).items()) for text in texts]
    telling = telling_positions(book, least)
    singles = [sum(1 for c in Counter(words).values() if c == 1) for _, words in book]
    vocabulary = np.unique(np.array([w for _, words in book for w in words], np.uint64))
    places: dict[int, list[tuple[int, int]]] = {}
    for k, (_, words) in enumerate(book):
        count = Counter(words)
        for j, w in enumerate(words):
            if count[w] == 1:
                places.setdefault(w, []).append((k, j))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offs in blocks(batch.column(1)):
                words = BareWords(raw, offs)
                h = words.hashes()
                spot = np.searchsorted(vocabulary, h)
                hits = np.flatnonzero(vocabulary[np.minimum(spot, len(vocabulary) - 1)] == h)
                row = np.searchsorted(words.first, hits, "right") - 1
                best: list = [None] * (b - a)
                names: list = [[] for _ in range(b - a)]
                count = [0] * (b - a)
                for lo, hi in _groups(row):
                    i = int(row[lo])
                    start = int(words.first[i])
                    votes: dict[int, list[tuple[int, int]]] = {}
                    for p in hits[lo:hi].tolist():
                        for k, j in places.get(int(h[p]), ()):
                            votes.setdefault(k, []).append((p - start - j, j))
                    own, places_found = None, []
                    for k, mine in votes.items():
                        name, notice = book[k]
                        if len({j for _, j in mine}) < (2 * least - 1) * singles[k]:
                            continue
                        own = own if own is not None else h[start : words.first[i + 1]].tolist()
                        for n, first, end in scan_words(own, mine, notice, least, telling[k]):
                            places_found.append((n, n / len(notice), name, first, end, len(notice)))
                    for _, cover, name, first, end, size in best_places(places_found):
                        rank = (-cover, -size, name, first, end)
                        best[i] = rank if best[i] is None else min(best[i], rank)
                        names[i].append(name)
                        count[i] += 1
                cols = [
                    pa.array([x and x[2] for x in best], pa.string()), pa.array([x and round(-x[0], 6) for x in best], pa.float64()), pa.array([x and x[3] for x in best], pa.int64()),
                    pa.array([x and x[4] for x in best], pa.int64()), pa.array([sorted(set(x)) for x in names], pa.list_(pa.string())), pa.array(count, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *cols], ["id", "license", "coverage", "first_word", "end_word", "licenses", "n_notices"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, license string, coverage double, first_word long, end_word long, licenses array<string>, n_notices long").withColumnRenamed("id", id_col)


def _groups(row: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1], [True]))) if len(row) else np.zeros(1, np.int64)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
