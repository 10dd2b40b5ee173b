"""Licence scans: patience alignment of texts with licence templates.

A text's words are aligned with a template's: words that occur once in both are anchors, the longest increasing
subsequence of their places is kept, and the gaps between kept anchors are aligned again, with words unique within the
gap, after equal heads and tails are taken off. Coverage is the part of the template's words that is aligned.

Texts are scanned whole for the templates' signal words. A template has so many of them that a text without any misses more
of its words than the coverage permits, so none is left out unseen. Around each group of signals, a window that can hold the
template is aligned if it has enough of the template's words, so a licence that is repeated, or stands amid other text, is found each time. Overlapping matches
of one text are settled in favour of more aligned words.

Defined cases: a null or empty text, or one without signal words, has no match; texts of any length are scanned whole;
repeated rows get equal matches; ties go to the earlier place, then to the first template by name; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare, strings

# Short public licence notices. A template's name is what is reported.
TEMPLATES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "BSD-conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met""",
    "BSD-notice": """Licensed under the BSD 3-Clause License.""",
    "CC-BY-NC-4.0": """Licensed under CC BY-NC 4.0.""",
    "CC-BY-4.0": """This work is licensed under a Creative Commons Attribution 4.0 International License.""",
    "GPL-3.0": """This work is licensed under the GNU General Public License, version 3.""",
    "GPL-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT": """Released under the MIT License.""",
    "MIT-permission": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.""",
    "rights-reserved": """All rights reserved.""",
}
WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")


@dataclass(frozen=True)
class Params:
    coverage: float = 0.8
    slack: float = 1.5  # a window holds so many times the template's words before and after a signal


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first, whose seconds increase; the patience sort's piles."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        i = bisect_left(tops, y)
        if i == len(tops):
            tops.append(y)
            at.append(k)
        else:
            tops[i], at[i] = y, k
        back.append(at[i - 1] if i else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), increasing in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        anchors = _increasing([(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in where])
        for i, j in anchors:
            out.append((i, j))
            work.append((a0, i, b0, j))
            a0, b0 = i + 1, j + 1
        if anchors:
            work.append((a0, a1, b0, b1))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, p: Params = Params()):
        self.p = p
        self.templates = {name: tokens(t) for name, t in sorted(templates.items())}
        # A template's signal: its words that the fewest templates have, the longest first, until they stand at more places
        # than may be missing: whatever reaches the coverage holds one.
        use = Counter(w for t in self.templates.values() for w in set(t))
        self.signals: dict[str, list[str]] = {}
        self.least: dict[str, int] = {}  # aligned words that reach the coverage
        for name, t in self.templates.items():
            self.least[name] = next(k for k in range(len(t) + 1) if k >= p.coverage * len(t))
            missing, times = len(t) - self.least[name], Counter(t)
            for w in sorted(times, key=lambda w: (use[w], -len(w), w)):
                if missing < 0:
                    break
                self.signals.setdefault(w, []).append(name)
                missing -= times[w]
        words = sorted(self.signals, key=lambda w: (-len(w), w))
        self.any = re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, words)) + r")(?![^\W_])")

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(template, first character, end, coverage) of each match, in order of place."""
        low = (text or "").lower()
        if len(low) != len(text or ""):  # lower-casing that moves characters would move spans
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        if not self.any.search(low):
            return []
        spans = [m.span() for m in WORD.finditer(low)]
        words = [low[a:b] for a, b in spans]
        near: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            for name in self.signals.get(w, ()):
                near.setdefault(name, []).append(i)
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.signals:
                places.setdefault(w, []).append(i)
        found = []
        for name, hits in near.items():
            t = self.templates[name]
            reach = int(len(t) * self.p.slack) + 2
            of, times = set(t), Counter(t)
            own = [i for i, w in enumerate(words) if w in of]
            upto = 0
            for i in hits:
                if i < upto:
                    continue
                lo, hi = max(upto, i - reach), i + reach
                got = self._fit(words, own, name, lo, hi)
                # The next notice has this signal again: without a match, or with one that ends in the next notice, the
                # window is cut before that. A match across the cut stays whole unless it hides a second notice.
                same = places[words[i]]
                k = bisect_left(same, i) + times[words[i]]
                if k < len(same) and same[k] < hi and (got is None or got[2] >= same[k]):
                    cut = self._fit(words, own, name, lo, same[k])
                    if cut and (got is None or cut[2] < got[1] or self._fit(words, own, name, cut[2] + 1, hi)):
                        got = cut
                while got and i < got[1]:  # a late match: one may lie before it
                    earlier = self._fit(words, own, name, lo, got[1])
                    if earlier is None:
                        break
                    got = earlier
                if got:
                    n, first, last = got
                    found.append((n, name, first, last, n / len(t)))
                    upto = last + 1
        found.sort(key=lambda x: (-x[0], -x[4], x[2], x[1]))
        taken: list[tuple[int, int]] = []  # in order, apart from one another
        out = []
        for _, name, first, last, share in found:
            k = bisect_left(taken, (first, 0))
            if (k == 0 or taken[k - 1][1] < first) and (k == len(taken) or last < taken[k][0]):
                taken.insert(k, (first, last))
                out.append((name, spans[first][0], spans[last][1], share))
        return sorted(out, key=lambda x: x[1])

    def _fit(self, words: list[str], own: list[int], name: str, lo: int, hi: int) -> tuple[int, int, int] | None:
        """Aligned words, first and last place of the match in words lo to hi; own: places of the template's words."""
        if bisect_left(own, hi) - bisect_left(own, lo) < self.least[name]:
            return None
        t = self.templates[name]
        pairs = self._tight(align(words[lo:hi], t), len(t))
        return (len(pairs), lo + pairs[0][0], lo + pairs[-1][0]) if len(pairs) >= self.least[name] else None

    @staticmethod
    def _tight(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
        """Drops aligned words at either end that stand far off the rest: more words apart than the template has."""
        while len(pairs) > 1 and pairs[1][0] - pairs[0][0] > n:
            pairs = pairs[1:]
        while len(pairs) > 1 and pairs[-1][0] - pairs[-2][0] > n:
            pairs = pairs[:-1]
        return pairs


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, p: Params = Params()) -> DataFrame:
    """doc_id, n_licenses, best, coverage, licenses (name:first:end:coverage, comma-joined): one row a row of docs."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        scanner = Scanner(templates, p)
        for b in batches:
            rows = []
            for t in strings(b, "text"):
                got = scanner.scan(t)
                best = min(got, key=lambda x: (-x[3], x[1], x[0]), default=None)
                rows.append((len(got), best and best[0], best[3] if best else 0.0, ",".join(f"{n}:{a}:{z}:{c:.3f}" for n, a, z, c in got)))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.string())], ["doc_id", "n_licenses", "best", "coverage", "licenses"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_licenses long, best string, coverage double, licenses string")
