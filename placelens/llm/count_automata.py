"""Weighted acyclic automata: phrases of at most ``WIDTH`` words, with their counts.

An arc carries a word and the count of the phrase that leads through it, so the weight of a phrase is that
of its last arc. States lie in levels by the number of words before them; within a level, states with the
same arcs (word, weight, target) are one state. Arcs of a state are sorted by word, words are numbered in byte order,
and all arcs of a level are numpy arrays, so that building, cutting, adding and reading work on whole levels.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import zstandard

WIDTH = 4
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass
class Grams:
    """Sorted different word sequences, as columns of word numbers from 1 (0 behind the end), each with the
    number of places where it is the longest sequence that begins there."""

    columns: list[np.ndarray]
    counts: np.ndarray

    def __len__(self) -> int:
        return len(self.counts)

    def part(self, low: int, high: int) -> Grams:
        return Grams([c[low:high] for c in self.columns], self.counts[low:high])


def _bits(values: np.ndarray) -> int:
    return int(values.max()).bit_length() if len(values) else 0


def _order(wide: list[np.ndarray]) -> np.ndarray:
    """Order of the rows; equal rows stand in any order. The first two words are replaced by the rank of their
    pair, so that a row is one number and is sorted as that."""
    width = max(map(_bits, wide))
    tail = _bits(wide[2]) + (last := _bits(wide[3]))
    if 2 * width <= 64 and len(wide[0]):
        pair = (wide[0] << np.uint64(width)) | wide[1]
        order = np.argsort(pair)
        pair = pair[order]
        rank = np.empty(len(pair), np.uint64)
        rank[order] = np.cumsum(np.r_[False, pair[1:] != pair[:-1]], dtype=np.uint64)
        if int(rank.max()).bit_length() + tail <= 64:
            return np.argsort((rank << np.uint64(tail)) | (wide[2] << np.uint64(last)) | wide[3])
    return np.lexsort(wide[::-1])


def sorted_grams(columns: list[np.ndarray], counts: np.ndarray | None = None) -> Grams:
    """Sort the rows and add the counts of equal ones."""
    n = len(columns[0])
    wide = [c.astype(np.uint64) for c in columns]
    order = _order(wide)
    high, low = ((a << np.uint64(32) | b)[order] for a, b in (wide[:2], wide[2:]))
    first = np.ones(n, bool)
    first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(first)
    if counts is None:
        counts = np.diff(np.append(at, n))
    else:
        counts = np.add.reduceat(counts[order], at) if n else counts
    kept = order[at]
    return Grams([c[kept] for c in columns], counts.astype(np.int64))


def grams_at_every_place(labels: np.ndarray) -> Grams:
    """The sequences of up to four words that begin at the places of ``labels``, not reaching over a 0."""
    x = np.concatenate((labels, np.zeros(WIDTH - 1, labels.dtype)))
    n = len(labels)
    columns = [x[:n]]
    for k in range(1, WIDTH):
        columns.append(np.where(columns[-1] == 0, 0, x[k:n + k]))
    kept = columns[0] != 0
    return sorted_grams([c[kept] for c in columns])


def first_at_or_behind(grams: Grams, words: list[bytes], phrase: tuple[bytes, ...]) -> int:
    """Place of the first row that is not before ``phrase`` in the order of words."""
    low, high = 0, len(grams)
    for column, word in zip(grams.columns, phrase, strict=False):
        k = bisect_left(words, word)
        here = column[low:high]
        start = low + int(np.searchsorted(here, k + 1))
        if k == len(words) or words[k] != word:
            return start
        low, high = start, low + int(np.searchsorted(here, k + 2))
    return low


def _merge_states(first: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray):
    """One state for all that have the same arcs: (class of every state, arcs of the classes)."""
    size = np.diff(first)
    x = (label.astype(np.uint64) * _A) ^ (weight.astype(np.uint64) * _B) ^ (target.astype(np.uint64) * _C)
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
    code = (sums[first[1:]] - sums[first[:-1]]) * _A + size.astype(np.uint64)
    order = np.argsort(code)
    changed = np.ones(len(order), bool)
    changed[1:] = code[order][1:] != code[order][:-1]
    model = np.empty(len(order), np.int64)
    model[order] = order[changed][np.cumsum(changed) - 1]
    # equal hashes are compared arc by arc; a state that differs stays by itself
    state = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(label)) - first[:-1][state]
    same_size = size[model] == size
    twin = np.where(same_size[state], first[:-1][model[state]] + inside, 0)
    wrong = ~same_size
    differs = (label[twin] != label) | (weight[twin] != weight) | (target[twin] != target)
    wrong[state[differs]] = True
    model = np.where(wrong, np.arange(len(size)), model)
    mask = np.zeros(len(size), bool)
    mask[model] = True
    kept = np.flatnonzero(mask)
    classes = (np.cumsum(mask) - 1)[model]
    sizes = size[kept]
    start = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    arcs = np.repeat(first[:-1][kept] - start[:-1], sizes) + np.arange(start[-1])
    return classes, (start, label[arcs], weight[arcs], target[arcs])


class CountAutomaton:
    """``levels[d]``: (first arc of every state and the end, word number, weight, target state) of the arcs behind
    ``d`` words. Level 0 has one state. ``words`` are sorted."""

    def __init__(self, words: list[bytes], levels: list[tuple[np.ndarray, ...]]) -> None:
        self.words, self.levels = words, levels

    @classmethod
    def build(cls, grams: Grams, words: list[bytes]) -> CountAutomaton:
        """From sorted sequences; words that do not occur are left out. The deepest states are finished
        and merged first, then those before them, since a target must be final before its arc can be compared."""
        occurs = np.zeros(len(words) + 1, bool)
        for column in grams.columns:
            occurs[column] = True
        occurs[0] = False
        used = np.flatnonzero(occurs)
        number = np.zeros(len(words) + 1, np.int64)
        number[used] = np.arange(1, len(used) + 1)
        n = len(grams)
        arcs, changed = [], np.zeros(n, bool)
        changed[:1] = True
        above = np.zeros(n, np.int64)  # the arc of the level before on which a row lies; level 0 has one state
        for column in grams.columns:
            changed = changed.copy()
            changed[1:] |= column[1:] != column[:-1]
            at = np.flatnonzero(changed)
            total = np.add.reduceat(grams.counts, at) if n else grams.counts
            real = column[at] != 0
            at = at[real]
            arcs.append((above[at], number[column[at]], total[real]))
            begins = np.zeros(n, np.int64)
            begins[at] = 1
            above = np.cumsum(begins) - 1
        levels: list[tuple[np.ndarray, ...]] = []
        target = np.zeros(len(arcs[-1][0]), np.int64)
        for d in range(WIDTH - 1, -1, -1):
            state, label, weight = arcs[d]
            states = 1 if d == 0 else len(arcs[d - 1][0])
            first = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(state, minlength=states))))
            if d == 0:
                levels.insert(0, (first, label, weight, target))
            else:
                classes, level = _merge_states(first, label, weight, target)
                levels.insert(0, level)
                target = classes
        return cls([words[k - 1] for k in used], levels)

    def grams(self) -> Grams:
        """The sequences again. What an arc's weight exceeds those behind it by, ends there."""
        behind = []
        for first, _, weight, _ in self.levels[1:]:
            sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(weight)))
            behind.append(sums[first[1:]] - sums[first[:-1]])
        columns, counts = [[] for _ in range(WIDTH)], []
        path, state = [], np.zeros(1, np.int64)
        for d, (first, label, weight, target) in enumerate(self.levels):
            size = first[state + 1] - first[state]
            row = np.repeat(np.arange(len(state)), size)
            arc = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + first[state][row]
            path = [c[row] for c in path] + [label[arc]]
            state = target[arc]
            own = weight[arc] - (behind[d][state] if d < WIDTH - 1 else 0)
            ends = own > 0
            for k in range(WIDTH):
                columns[k].append(path[k][ends] if k <= d else np.zeros(int(ends.sum()), np.int64))
            counts.append(own[ends])
        return Grams([np.concatenate(c) for c in columns], np.concatenate(counts))

    @classmethod
    def union(cls, automata: list[CountAutomaton]) -> CountAutomaton:
        """All phrases of all, with the sums of their weights."""
        words = sorted(set().union(*(a.words for a in automata)))
        number = {word: k + 1 for k, word in enumerate(words)}
        parts = []
        for a in automata:
            to = np.zeros(len(a.words) + 1, np.int64)
            to[1:] = np.fromiter(map(number.__getitem__, a.words), np.int64, len(a.words))
            g = a.grams()
            parts.append(([to[c].astype(np.uint32) for c in g.columns], g.counts))
        columns = [np.concatenate([p[0][k] for p in parts]) for k in range(WIDTH)]
        return cls.build(sorted_grams(columns, np.concatenate([p[1] for p in parts])), words)

    def phrases(self, least: int, also: set[tuple[bytes, ...]] = frozenset()) -> list[tuple[tuple[bytes, ...], int]]:
        """Phrases of a weight of at least ``least``, and those in ``also`` that occur. Behind a lighter arc there
        is nothing heavier, so the walk stops there."""
        out, path, state = [], [], np.zeros(1, np.int64)
        for first, label, weight, target in self.levels:
            size = first[state + 1] - first[state]
            row = np.repeat(np.arange(len(state)), size)
            arc = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + first[state][row]
            kept = weight[arc] >= least
            row, arc = row[kept], arc[kept]
            path = [c[row] for c in path] + [label[arc]]
            state = target[arc]
            out += zip(zip(*([self.words[k - 1] for k in c.tolist()] for c in path), strict=True), weight[arc].tolist(), strict=True)
        known = {phrase for phrase, _ in out} if also else ()
        for phrase in also:
            if phrase not in known and (found := self.weight(phrase)):
                out.append((phrase, found))
        return out

    def weight(self, phrase: tuple[bytes, ...]) -> int:
        """Count of one phrase; 0 if it does not occur."""
        state, found = 0, 0
        for (first, label, weight, target), word in zip(self.levels, phrase, strict=False):
            k = bisect_left(self.words, word)
            if k == len(self.words) or self.words[k] != word:
                return 0
            low, high = int(first[state]), int(first[state + 1])
            arc = low + int(np.searchsorted(label[low:high], k + 1))
            if arc == high or label[arc] != k + 1:
                return 0
            state, found = int(target[arc]), int(weight[arc])
        return found

    def places(self) -> int:
        """Words counted: the weights of all arcs that begin a phrase."""
        return int(self.levels[0][2].sum())

    def to_bytes(self) -> bytes:
        content = b" ".join(self.words)
        parts = [struct.pack("<q", len(content)), content]
        for first, *arcs in self.levels:
            for array in (np.diff(first), *arcs):
                most = int(array.max()) if len(array) else 0
                width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
                parts += [struct.pack("<qb", len(array), width), array.astype(f"<u{width}").tobytes()]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))

    @classmethod
    def from_bytes(cls, packed: bytes) -> CountAutomaton:
        content = zstandard.ZstdDecompressor().decompress(packed)
        (size,), at = struct.unpack_from("<q", content), 8
        words, at = content[at:at + size].split(b" ") if size else [], at + size
        levels = []
        for _ in range(WIDTH):
            arrays = []
            for _ in range(4):
                n, width = struct.unpack_from("<qb", content, at)
                arrays.append(np.frombuffer(content, f"<u{width}", n, at + 9).astype(np.int64))
                at += 9 + n * width
            levels.append((np.concatenate((np.zeros(1, np.int64), np.cumsum(arrays[0]))), *arrays[1:]))
        return cls(words, levels)
