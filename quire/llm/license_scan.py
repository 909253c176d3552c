"""Licence scan: which licence notices a text holds, and where.

A text is cut into overlapping windows of words, one size for each group of notices of
like length, so that every place where a notice may stand lies whole in some window, also
with foreign words in it up to half of the longest notice of its group.
MinHash bands of the windows retrieve notices; the number of bands is chosen so that a
window with a notice at the containment limit collides with a probability of at least
1 - ``miss``. Retrieved notices are verified: the share of the notice's distinct
shingles that the window holds must reach ``percent``.

Windows that hold fewer shingles of any notice than the shortest match of their group
needs cannot pass the verification and are not sketched.

Defined cases: a null or empty text has no words and no licences; a notice shorter than
a shingle is one shingle; the same notice in several places is listed once and counted in
``matches``; repeated rows are scanned alike; an empty table gives no rows. Other columns
are kept; an input column named like an output column is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from quire.llm.arrow_ops import add_columns, col, lowered, texts

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# fixed values: the wording of public licence notices, (licence, notice)
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain worldwide"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("AGPL", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("LGPL", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: str) -> list[str]:
    return _WORDS.findall(lowered(text))


def band_count(similarity: float, rows: int, miss: float) -> int:
    """Bands of ``rows`` values so that sets of this similarity share one but for ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))


class Group:
    """Notices of like length, the windows for them and their bands."""

    def __init__(self, notices: list[tuple[int, frozenset[int], int]], rows: int, percent: int, miss: float, shingle: int):
        self.notices, self.rows = notices, rows
        longest = max(n for _, _, n in notices)
        self.window, self.stride = 2 * longest, max(1, longest // 2)
        self.need = {i: -(-percent * len(s) // 100) for i, s, _ in notices}
        self.least = min(self.need.values())
        places = self.window - min(shingle, longest) + 1
        # the least similar match: just enough of the notice, all else in the window foreign
        similarity = min(self.need[i] / (places + len(s) - self.need[i]) for i, s, _ in notices)
        self.bands = band_count(similarity, rows, miss)
        self.odd = np.random.default_rng(5).integers(1, 1 << 62, self.bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.buckets: dict[tuple, list[int]] = {}
        self.sets = {i: s for i, s, _ in notices}
        for i, s, _ in notices:
            for key in self.keys(np.array(sorted(s), np.uint64)):
                self.buckets.setdefault(key, []).append(i)

    def keys(self, shingles: np.ndarray):
        with np.errstate(over="ignore"):
            x = (shingles + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            low = (x[None, :] * self.odd[:, None]).min(axis=1)
        for b in range(self.bands):
            yield (b, *low[b * self.rows : (b + 1) * self.rows].tolist())

    def retrieve(self, shingles: np.ndarray) -> set[int]:
        found: set[int] = set()
        for key in self.keys(shingles):
            found.update(self.buckets.get(key, ()))
        return found


class Scanner:
    def __init__(self, notices: Sequence[tuple[str, str]] = NOTICES, percent: int = 90, shingle: int = 3, rows: int = 2, miss: float = 1e-6):
        self.names = [name for name, _ in notices]
        self.shingle, self.percent = shingle, percent
        self.words: dict[str, int] = {}
        self.codes: dict[tuple[int, ...], int] = {}
        made = []
        for i, (_, text) in enumerate(notices):
            ids = [self.words.setdefault(w, len(self.words)) for w in words_of(text)]
            if ids:
                k = min(shingle, len(ids))
                grams = {tuple(ids[j : j + k]) for j in range(len(ids) - k + 1)}
                made.append((i, frozenset(self.codes.setdefault(g, len(self.codes)) for g in grams), len(ids)))
        made.sort(key=lambda m: m[2])
        self.groups: list[Group] = []
        start = 0
        for j in range(1, len(made) + 1):  # lengths of a group are within a quarter
            if j == len(made) or made[j][2] > 1.25 * made[start][2]:
                self.groups.append(Group(made[start:j], rows, percent, miss, shingle))
                start = j
        self.sizes = sorted({len(g) for g in self.codes})

    def scan(self, words: Sequence[str]) -> list[tuple[int, int, int, float]]:
        """(notice, start, stop, containment) of each match: the words of the shortest
        stretch that holds enough of the notice, with what adjoins it. Overlapping finds of
        one notice are one. Of several notices those with the highest containment, then the
        fewest foreign words, then the longest stay; others go only where most of their shingles are theirs."""
        known = self.words.get
        ids = [known(w, -1) for w in words]
        hits: list[tuple[int, int]] = []  # place, shingle code
        for k in self.sizes:
            for j in range(len(ids) - k + 1):
                if ids[j] >= 0:
                    code = self.codes.get(tuple(ids[j : j + k]))
                    if code is not None:
                        hits.append((j, code))
        if not hits:
            return []
        hits.sort()
        place = np.array([h[0] for h in hits])
        code = np.array([h[1] for h in hits], np.uint64)
        made: dict[int, set[tuple[int, int]]] = {}  # first and last hit of the stretches of each notice
        for g in self.groups:
            # windows start at multiples of the stride; a window has the shingles that lie whole in it
            for w in np.unique(np.concatenate([np.maximum(place // g.stride - k, 0) for k in range(-(-g.window // g.stride))])):
                a, b = np.searchsorted(place, [w * g.stride, w * g.stride + g.window])
                if b - a < g.least:
                    continue
                own = np.unique(code[a:b])
                if len(own) < g.least:
                    continue
                for i in g.retrieve(own):
                    shared = [x for x in range(a, b) if int(code[x]) in g.sets[i]]
                    if len({int(code[x]) for x in shared}) >= g.need[i]:
                        made.setdefault(i, set()).update(self.stretches(shared, place, code, g.need[i]))
        found: list[tuple[tuple[int, int, int, float], set[int]]] = []
        for i, ends in made.items():
            g = next(g for g in self.groups if i in g.sets)
            finds = []
            for first, last in ends:
                held = {x for x in range(first, last + 1) if int(code[x]) in g.sets[i]}
                share = len({int(code[x]) for x in held}) / len(g.sets[i])
                finds.append(((i, int(place[first]), min(len(words), int(place[last]) + self.shingle), share), held))
            finds.sort(key=lambda f: (-f[0][3], f[0][2] - f[0][1], f[0][1]))
            kept: list[tuple[tuple[int, int, int, float], set[int]]] = []
            for f in finds:
                if not any(2 * len(f[1] & o[1]) > len(f[1]) for o in kept):
                    kept.append(f)
            found += kept
        # of notices that differ in a word or two, the one that fits best stands for the place
        length = {i: n for g in self.groups for i, _, n in g.notices}
        rank = lambda m, held: (m[3], min(0, length[m[0]] - (m[2] - m[1])), length[m[0]])
        found.sort(key=lambda f: (*(-r for r in rank(*f)), f[0]))
        stay: list[tuple[tuple[int, int, int, float], set[int]]] = []
        for m, held in found:
            others = set().union(*(theirs for o, theirs in stay if rank(o, theirs) > rank(m, held)))
            if 2 * len(held & others) <= len(held):
                stay.append((m, held))
        return sorted(m for m, _ in stay)

    def stretches(self, shared: Sequence[int], place: np.ndarray, code: np.ndarray, need: int) -> list[tuple[int, int]]:
        """The first and last of the hits ``shared`` in each of the shortest stretches with
        ``need`` distinct shingles, disjoint, each with the new shingles that adjoin it."""
        seen: dict[int, int] = {}
        left, short = 0, []
        for right, x in enumerate(shared):
            seen[int(code[x])] = seen.get(int(code[x]), 0) + 1
            while seen[c := int(code[shared[left]])] > 1:
                seen[c] -= 1
                left += 1
            while len(seen) >= need:
                short.append((int(place[x] - place[shared[left]]), left, right))
                del seen[int(code[shared[left]])]
                left += 1
                while left <= right and seen[c := int(code[shared[left]])] > 1:
                    seen[c] -= 1
                    left += 1
        taken: list[tuple[int, int]] = []
        gap = self.shingle + 1  # one foreign word lies between
        for _, a, b in sorted(short):
            if any(a <= d and c <= b for c, d in taken):
                continue
            low = max((d + 1 for _, d in taken if d < a), default=0)
            high = min((c for c, _ in taken if c > b), default=len(shared))
            new = {int(code[x]) for x in shared[a : b + 1]}
            while b + 1 < high and place[shared[b + 1]] - place[shared[b]] <= gap and int(code[shared[b + 1]]) not in new:
                b += 1
                new.add(int(code[shared[b]]))
            while a > low and place[shared[a]] - place[shared[a - 1]] <= gap and int(code[shared[a - 1]]) not in new:
                a -= 1
                new.add(int(code[shared[a]]))
            taken.append((a, b))
        return [(shared[a], shared[b]) for a, b in taken]


def scan(
    docs: DataFrame, text: str = "text", notices: Sequence[tuple[str, str]] = NOTICES, percent: int = 90, shingle: int = 3, rows: int = 2, miss: float = 1e-6
) -> DataFrame:
    """``docs`` with n_words, licenses (sorted names) and matches (license, start and stop
    word, containment)."""

    def make():
        scanner = Scanner(notices, percent, shingle, rows, miss)

        def compute(array):
            out = []
            for value in texts(array):
                words = words_of(value)
                found = scanner.scan(words)
                matches = [{"license": scanner.names[i], "start": a, "stop": b, "containment": c} for i, a, b, c in found]
                out.append((len(words), sorted({m["license"] for m in matches}), matches))
            return list(zip(*out, strict=True))

        return compute

    return add_columns(
        docs, [col(text).cast("string")], "n_words long, licenses array<string>, matches array<struct<license: string, start: int, stop: int, containment: double>>", make
    )
