"""License scans by patience alignment.

A text and a template are aligned on words that occur once in both: of these anchors the longest
increasing subsequence is kept, and the gaps between neighbouring anchors are aligned in the same way,
where more words are unique. Before and after each gap equal words are matched directly. The coverage is
the share of the template's words that are aligned.

Templates are a bounded list given by the caller; ``TEMPLATES`` holds whole texts (MIT, BSD with three
clauses, Apache 2.0, GPL 2 and 3) and short notices. Licenses outside it are not found. Defined results: null and empty texts match nothing;
repeated rows are all returned; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import license_texts

COVERAGE = 0.8
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")

# Fixed values. A template is named by the SPDX name of its license, with "#" and a kind where there are
# several: opening sentences, whole texts, and short notices under the names that are in use.
TEMPLATES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "ARR": "All rights reserved",
    "MIT#text": license_texts.MIT,
    "BSD-3-Clause#text": license_texts.BSD_3,
    "Apache-2.0#text": license_texts.APACHE_2,
    "GPL-2.0#text": license_texts.GPL_2,
    "GPL-3.0#text": license_texts.GPL_3,
}
_CREATIVE = {
    "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
TEMPLATES |= {f"CC-{k}-4.0": f"This work is licensed under a Creative Commons {v} 4.0 International License" for k, v in _CREATIVE.items()}
NAMES = {
    "MIT": ["MIT License"],
    "BSD": ["BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"],
    **{f"CC-{k}-4.0": [f"CC {k} 4.0"] for k in ("BY", "BY-SA", *_CREATIVE)},
}
for _license, _names in NAMES.items():
    for _k, _name in enumerate(_names):
        for _verb in ("released", "licensed", "distributed", "available"):
            TEMPLATES[f"{_license}#{_verb} {_k}"] = f"{_verb} under {_name}"
    if _license != "BSD":
        TEMPLATES[f"{_license}#spdx"] = f"SPDX-License-Identifier: {_license}"
TRIES = 12  # alignments of one place of a notice, of which the best counts
SHORT = 10  # words; each of a shorter template may be the license's name, so all must be there, and close


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (ascending first parts) with ascending second parts."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        before.append(piles[at - 1] if at else -1)
        tops[at:at + 1] = [b]
        piles[at:at + 1] = [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Aligned places of two word lists, ascending in both."""
    out, stack = [], [(0, len(x), 0, len(y))]
    while stack:
        a, b, c, d = stack.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once_x, once_y = Counter(x[a:b]), Counter(y[c:d])
        where = {w: k for k, w in enumerate(y[c:d], c) if once_y[w] == 1}
        pairs = [(k, where[w]) for k, w in enumerate(x[a:b], a) if once_x[w] == 1 and w in where]
        kept = _increasing(pairs)
        ends = [(a - 1, c - 1), *kept, (b, d)]
        out += kept
        if kept:
            stack += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def _common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, as far to the left in ``x`` as it goes."""
    number = {w: k for k, w in enumerate(dict.fromkeys(y))}
    codes = np.array([number.get(w, -1) for w in x], np.int32)
    rows = np.zeros((len(y) + 1, len(x) + 1), np.int32)
    for k, w in enumerate(y):
        rows[k + 1, 1:] = np.maximum.accumulate(np.maximum(rows[k, 1:], rows[k, :-1] + (codes == number[w])))
    out, i, k = [], len(x), len(y)
    while i and k:
        if rows[k, i] == rows[k, i - 1]:
            i -= 1
        elif rows[k, i] == rows[k - 1, i]:
            k -= 1
        else:
            i, k = i - 1, k - 1
            out.append((i, k))
    return out[::-1]


def _after(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Aligned places of what follows an anchor: first what is equal at once, then by anchors up to the
    last one, then, where no word is unique, a longest common subsequence close to it."""
    k = 0
    while k < min(len(x), len(y)) and x[k] == y[k]:
        k += 1
    out = [(j, j) for j in range(k)]
    x, y, at = x[k:], y[k:], k
    if not y or not x:
        return out
    once_x, once_y = Counter(x), Counter(y)
    where = {w: j for j, w in enumerate(y) if once_y[w] == 1}
    kept = _increasing([(j, where[w]) for j, w in enumerate(x) if once_x[w] == 1 and w in where])
    a = c = 0
    for p, q in kept:
        gap = align(x[a:p], y[c:q]) or _common(x[a:p], y[c:q])
        out += [(at + a + i, at + c + j) for i, j in gap] + [(at + p, at + q)]
        a, c = p + 1, q + 1
    return out + [(at + a + i, at + c + j) for i, j in _common(x[a:], y[c:])]


def _around(text: list[str], template: list[str], at: int, place: int, low: int, high: int) -> list[tuple[int, int]]:
    """Aligned places when word ``at`` of the text is word ``place`` of the template, in text[low:high]."""
    before = _after(text[low:at][::-1], template[:place][::-1])
    after = _after(text[at + 1: high], template[place + 1:])
    return [*((at - 1 - i, place - 1 - k) for i, k in reversed(before)), (at, place), *((at + 1 + i, place + 1 + k) for i, k in after)]


def _compact(pairs: list[tuple[int, int]], need: float) -> list[tuple[int, int]]:
    """The run of pairs with the most words aligned less words of the text between them, if that is enough;
    so what is missing from a notice isn't taken from another one."""
    best = value = first = 0
    kept = (0, 0)
    for k, (at, _) in enumerate(pairs):
        value -= at - pairs[k - 1][0] - 1 if k else 0
        if value <= 0:
            value, first = 0, k
        value += 1
        if value > best:
            best, kept = value, (first, k + 1)
    return pairs[slice(*kept)] if kept[1] - kept[0] >= need else pairs


class _Bounds:
    """Upper bounds of what an alignment in text[low:high] can reach. A longest common subsequence is at least
    as long as any alignment, and bit vectors (a bit for each place of the template) give it for all prefixes of
    the text and the template at once. They are worked out for one stretch of four template lengths at a time,
    with the windows that may begin or end outside it."""

    def __init__(self, text: list[str], low: int, high: int, template: list[str], anchors: set[str], need: float) -> None:
        self.text, self.low, self.high, self.need = text, low, high, need
        self.size, self.total, self.anchors = len(template), Counter(template), anchors
        self.forward, self.backward = self._masks(template), self._masks(template[::-1])
        self.stretch: int | None = None
        self.foreign: dict[int, int] = {}

    @staticmethod
    def _masks(template: list[str]) -> dict[str, int]:
        out: dict[str, int] = {}
        for k, w in enumerate(template):
            out[w] = out.get(w, 0) | 1 << k
        return out

    def _pass(self, places: range, masks: dict[str, int]) -> tuple[dict[int, int], int]:
        """For each place of an anchor the free bits before it, and the free bits at the end."""
        full = (1 << self.size) - 1
        free, out = full, {}
        for at in places:
            word = self.text[at]
            if hits := masks.get(word):
                if word in self.anchors:
                    out[at] = free
                taken = free & hits
                free = ((free + taken) | (free - taken)) & full
        return out, free

    def _enter(self, stretch: int) -> None:
        self.stretch, wide = stretch, 4 * self.size
        start = self.low + stretch * wide
        a, b = max(self.low, start - wide // 2), min(self.high, start + wide + wide // 2)
        known = [k for k in range(a, b) if self.text[k] in self.total]
        self.open = (Counter(self.text[k] for k in known) & self.total).total() >= self.need
        if not self.open:
            return
        self.before, free = self._pass(range(a, b), self.forward)
        self.open = self.size - free.bit_count() >= self.need
        if self.open:
            self.after, _ = self._pass(range(b - 1, a - 1, -1), self.backward)
            least = ceil(self.need)
            # words that are not the template's, in any run that holds enough words that are
            self.foreign[stretch] = min((q - p + 1 - least for p, q in zip(known, known[least - 1:], strict=False)), default=0)

    def foreign_of(self, at: int) -> int:
        """At least so many words in a place found around ``at`` are not the template's."""
        return self.foreign[(at - self.low) // (4 * self.size)]

    def pairs(self, at: int, place: int) -> int:
        """No alignment in which word ``at`` is word ``place`` of the template has more pairs; 0 if it is too few."""
        stretch = (at - self.low) // (4 * self.size)
        if stretch != self.stretch:
            self._enter(stretch)
        if not self.open:
            return 0
        rest = self.size - 1 - place
        left = place - (self.before[at] & ((1 << place) - 1)).bit_count()
        right = rest - (self.after[at] & ((1 << rest) - 1)).bit_count()
        return left + right + 1 if left + right + 1 >= self.need else 0


def _candidates(text: list[str], low: int, high: int, template: list[str], least: float) -> list[tuple[float, int, int]]:
    """Places of the template in text[low:high], which may overlap. Each occurrence of the word of a
    rare place of the template gives a window, once whole and once cut at the word's next occurrences: a notice that is
    repeated close by is then still aligned with one copy of itself. Windows that cannot hold enough of the template are
    not aligned; the others come by how much they may hold, and no window is aligned around a word of a place that it
    cannot better, or of one without room for a second one that ``TRIES`` windows have given already."""
    own: dict[str, list[int]] = {}
    for k, w in enumerate(template):
        own.setdefault(w, []).append(k)
    at_of: dict[str, list[int]] = {}
    for k in range(low, high):
        if text[k] in own:
            at_of.setdefault(text[k], []).append(k)
    if sum(len(own[w]) for w in at_of) < least * len(template):
        return []
    size, need = len(template), least * len(template)
    missing = size - int(need) + 1
    total = Counter(template)
    if sum(min(len(at_of[w]), total[w]) for w in at_of) < need:
        return []
    rare = sorted(range(size), key=lambda k: (len(at_of.get(template[k], ())), k))[:missing]  # one is in any match
    anchors = sorted((at, place) for place in rare for at in at_of.get(template[place], ()))
    bounds = _Bounds(text, low, high, template, {template[k] for k in rare}, need)
    most = {(at, place): pairs for at, place in anchors if (pairs := bounds.pairs(at, place))}
    foreign = bounds.foreign_of
    out: list[tuple[float, int, int]] = []
    aligned: set[tuple[int, int]] = set()  # of places found
    best = np.full(high - low, np.iinfo(np.int64).max)  # of a place found around a word: its length less twice its pairs
    tried = np.zeros(high - low, np.int64)  # windows that gave a place with no room for a second one around a word
    for at, place in sorted(most, key=lambda x: (-most[x], len(at_of[template[x[1]]]), x)):
        if (at, place) in aligned or tried[at - low] >= TRIES or foreign(at) - most[at, place] >= best[at - low]:
            continue
        found = at_of[template[place]]
        k = bisect_left(found, at)
        wide = (max(low, at - 2 * size), min(high, at + 2 * size))
        cut = (max(wide[0], found[k - 1] + 1 if k else low), min(wide[1], found[k + 1] if k + 1 < len(found) else high))
        for a, b in dict.fromkeys((cut, wide)):
            if (Counter(text[a:b]) & total).total() < need:
                continue
            pairs = _compact(_around(text, template, at, place, a, b), need)
            start, end = pairs[0][0], pairs[-1][0] + 1
            if len(pairs) < need or size < SHORT and (len(pairs) < size or end - start > 2 * size):
                continue
            out.append((len(pairs) / size, start, end))
            aligned.update(pairs)
            inside = best[start - low: end - low]
            np.minimum(inside, end - start - 2 * len(pairs), out=inside)
            tried[start - low: end - low] += end - start <= size + missing
            if len(pairs) == size == end - start:
                break
    return out


def scan(text: list[str], template: list[str], least: float) -> list[tuple[float, int, int]]:
    """(coverage, first word, end) of the places of the template, by place. Of places that overlap the one
    with the fewest words missing or inserted, then the first counts; what is left of the text between them is searched again."""
    out, parts = [], [(0, len(text))] if template else []
    while parts:
        low, high = parts.pop()
        taken: list[tuple[float, int, int]] = []
        for new in sorted(_candidates(text, low, high, template, least), key=lambda p: (p[2] - p[1] - 2 * p[0] * len(template), p[1])):
            k = bisect_left(taken, new[1], key=lambda p: p[1])
            if (k == 0 or taken[k - 1][2] <= new[1]) and (k == len(taken) or new[2] <= taken[k][1]):
                taken.insert(k, new)
        if taken:
            ends = [low, *(x for _, a, b in taken for x in (a, b)), high]
            parts += [(a, b) for a, b in zip(ends[::2], ends[1::2], strict=True) if a < b]
            out += taken
    return sorted(out, key=lambda p: p[1])


def notices(own: list[str], templates: dict[str, list[str]], least: float) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, end) of all places. Where templates overlap, the one with more
    words found counts: a whole text and not its first sentence, BY-NC and not BY."""
    seen, places = set(own), []
    for name, template in templates.items():
        if template[0] not in seen and len(template) < SHORT:
            continue
        if sum(w in seen for w in template) >= (least if len(template) >= SHORT else 1.0) * len(template):
            places += [(round(c * len(template)), c, a, b, name.split("#")[0]) for c, a, b in scan(own, template, least)]
    kept: list[tuple[int, int, float, str]] = []
    for _, c, a, b, name in sorted(places, key=lambda p: (-p[0], -p[1], p[3] - p[2], p[2], p[4])):
        k = bisect_left(kept, (a,))
        if (k == 0 or kept[k - 1][1] <= a) and (k == len(kept) or b <= kept[k][0]):
            kept.insert(k, (a, b, c, name))
    return [(name, c, a, b) for a, b, c, name in kept]


def _scan(templates: dict[str, str], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = {name: words(t) for name, t in templates.items()}
        for batch in batches:
            rows = {"doc_id": [], "license": [], "coverage": [], "start_word": [], "end_word": []}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = words(text)
                for found in notices(own, cut, least):
                    for c, v in zip(rows, (doc_id, *found), strict=True):
                        rows[c].append(v)
            yield pa.RecordBatch.from_pydict(rows, pa.schema([
                ("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()),
                ("start_word", pa.int64()), ("end_word", pa.int64()),
            ]))

    return run


def license_notices(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = COVERAGE, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(doc_id, license, coverage, start_word, end_word) of every notice in a document; they don't overlap."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(
        _scan(dict(templates), least), "doc_id long, license string, coverage double, start_word long, end_word long"
    )
