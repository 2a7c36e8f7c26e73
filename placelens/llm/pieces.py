"""Cutting texts, before tokenizing, at places where the tokenizers' own pattern always cuts.

Byte-level BPE patterns of the public kind let a blank only begin a piece, or be part of a run of white
space. A single blank between two characters that are no white space therefore always begins a new
piece, and a single newline between two such characters is a piece of its own. Texts cut there give
units that repeat across a corpus, so that the ids of a unit are worked out once and then looked up.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RUNS = re.compile(r"\s\s")
_BLANK = re.compile(r"(?<=\S)(?= \S)")
_CUT = "\0"
PUNCTUATION = ".,;:!?&%$#*)\"|"  # no apostrophe, which may belong to what follows it
MOST_BYTES = 96 << 20  # of the table that a worker holds, as estimated
ENTRY_BYTES = 200  # of a unit besides its characters and ids: two objects and their place in the table
LONG_UNIT = 64  # characters; longer units are not kept
GROUP_CHARS = 2_000_000  # of text whose units are looked up together
GROUP_BYTES = 12_000_000  # of text, likewise, where the table is a column
MADE = 50_000  # parts that have objects of their own at once, while they are encoded
PART_BYTES = 100  # of a part besides its characters and ids: offsets, and its place among the parts as they are numbered
_ENDED = r"[A-Za-zÀ-ÖØ-öø-ʯ]$"  # letters in every version of Unicode that a tokenizer may have


def units_of(text: str) -> list[str]:
    """The units of a text, each with the blank before it."""
    if _CUT in text:
        return _BLANK.split(text)
    return _marked(text).split(_CUT)


def _marked(text: str) -> str:
    """A text that has no ``_CUT``, with it between units."""
    if _RUNS.search(text):
        return _BLANK.sub(_CUT, text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0")


def _cut(texts: list[str]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where the units of each text end; the units, numbered."""
    if any(_CUT in text for text in texts):
        lists = list(map(units_of, texts))
        return np.cumsum(list(map(len, lists))), pa.array(chain.from_iterable(lists), pa.large_string()).dictionary_encode()
    split = pc.split_pattern(pa.array(map(_marked, texts), pa.large_string()), _CUT)
    return split.offsets.to_numpy()[1:], split.values.dictionary_encode()


def _strings(column: pa.Array) -> list[str]:
    """The strings of a column without nulls."""
    if not len(column) or pc.any(pc.match_substring(column, _CUT)).as_py():
        return column.to_pylist()
    listed = pa.ListArray.from_arrays([0, len(column)], column)
    return pc.binary_join(listed, pa.scalar(_CUT, column.type))[0].as_py().split(_CUT)  # takes less time than a string after the other


def _numbered(texts: list[str]) -> tuple[np.ndarray, pa.Array, list[str]]:
    """Where the units of each text end; a number for each unit; the different units by number."""
    ends, units = _cut(texts)
    return ends, units.indices, _strings(units.dictionary)


class CutTexts:
    """The joined bytes of the units of texts.

    One table holds the bytes of the units in use, in two generations: when the newer one reaches half of the
    bytes allowed, the older is forgotten, and what is asked for again moves to the newer. Punctuation behind a
    letter is a piece of its own, so a unit with such an end takes the bytes of the unit without it, and those
    of the end."""

    def __init__(self, make_many: Callable[[list[str]], list[bytes]], most_bytes: int = MOST_BYTES) -> None:
        self._make_many, self._half = make_many, most_bytes // 2
        self.new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._size = 0

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """One result for each text, in order; None counts as empty."""
        group, chars = [], 0
        for text in texts:
            group.append(text or "")
            chars += len(group[-1])
            if chars >= GROUP_CHARS:
                yield from self._group(group)
                group, chars = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        if self._size >= self._half:
            self._old, self.new, self._size = self.new, {}, 0
        if not texts:
            return
        ends, numbers, units = _numbered(texts)
        found = list(map(self.new.get, units))
        if None in found:
            missing = [unit for unit, ids in zip(units, found, strict=True) if ids is None]
            self._fill(missing)
            found = list(map(self.new.__getitem__, units))
            for unit in missing:
                if len(unit) > LONG_UNIT:
                    for part in (unit, unit.rstrip(PUNCTUATION), unit[len(unit.rstrip(PUNCTUATION)):]):
                        if len(part) > LONG_UNIT and part in self.new:
                            self._size -= _cost(part, self.new.pop(part))
        joined = pa.array(found, pa.large_binary()).take(numbers)
        _, places, content = joined.buffers()
        stops = np.frombuffer(places, np.int64)[ends].tolist()
        for begin, end in zip([0, *stops], stops, strict=False):
            yield content[begin:end].to_pybytes()

    def _fill(self, missing: list[str]) -> None:
        """Put all of ``missing``, which are different, in the newer generation."""
        missing = self._remembered(missing)
        stems = [unit.rstrip(PUNCTUATION) for unit in missing]
        ends = [stem is not unit and stem[-1:].isalpha() for unit, stem in zip(missing, stems, strict=True)]
        wanted = {stem if end else unit for unit, stem, end in zip(missing, stems, ends, strict=True)}
        cut = [(unit, stem, unit[len(stem):]) for unit, stem, end in zip(missing, stems, ends, strict=True) if end]
        wanted.update([end for _, _, end in cut])
        make = self._remembered([unit for unit in wanted if unit not in self.new])
        if make:
            self._put(make, self._make_many(make))
        new = self.new
        self._put([unit for unit, _, _ in cut], [new[stem] + new[end] for _, stem, end in cut])

    def _remembered(self, units: list[str]) -> list[str]:
        """Move what the older generation has to the newer; the others."""
        old = self._old
        moved = [unit for unit in units if unit in old]
        if not moved:
            return units
        self._put(moved, list(map(old.__getitem__, moved)))
        return [unit for unit in units if unit not in old]

    def _put(self, units: list[str], made: list[bytes]) -> None:
        """Units that the newer generation does not have."""
        self.new.update(zip(units, made, strict=True))
        self._size += ENTRY_BYTES * len(units) + sum(map(len, units)) + sum(map(len, made))


def _cost(unit: str, ids: bytes) -> int:
    return ENTRY_BYTES + len(unit) + len(ids)


class CutColumns:
    """The joined ids of the units of a column of texts.

    As ``CutTexts``, but units meet their ids without an object for each. The table holds parts, which are units
    without the punctuation behind a letter, and such punctuation. It stands before the parts of a group as they are
    numbered, so the numbers of parts are their places in it. When it is over the bytes allowed, parts that were
    not met again since the last time go, and the oldest of the others until half of the bytes are free."""

    def __init__(self, make_many: Callable[[list[str]], list[bytes]], most_bytes: int = MOST_BYTES) -> None:
        self._make_many, self._most = make_many, most_bytes
        self.parts, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self._again = np.zeros(0, bool)

    def encode(self, texts: pa.Array) -> Iterator[pa.Array]:
        """One result for each text, in order, as arrays; null counts as empty."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + GROUP_BYTES, "right")))
            yield self._group([text or "" for text in texts[start:stop].to_pylist()])
            start = stop

    def _group(self, texts: list[str]) -> pa.Array:
        ends, units = _cut(texts)
        numbers = units.indices.to_numpy()
        ids, place = self._units(units.dictionary, np.bincount(numbers) > 1)
        joined = ids.take(pa.array(place[numbers]))
        self._forget()
        _, places, content = joined.buffers()
        stops = np.frombuffer(places, np.int64)[np.r_[0, ends]]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(stops), content])

    def _units(self, units: pa.Array, twice: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Ids, and where in them those of the units stand, which are different; ``twice`` tells those that come again."""
        stems = pc.utf8_rtrim(units, characters=PUNCTUATION)
        cut = pc.and_(pc.less(pc.binary_length(stems), pc.binary_length(units)), pc.match_substring_regex(stems, _ENDED))
        ended = zip(_strings(units.filter(cut)), _strings(stems.filter(cut)), strict=True)
        tails = pa.array([unit[len(stem):] for unit, stem in ended], pa.large_string())
        known = len(self.parts)
        numbered = pa.concat_arrays([self.parts, pc.if_else(cut, stems, units), tails]).dictionary_encode()
        numbers = numbered.indices[known:]
        first, second = numbers[:len(units)], numbers[len(units):]
        self._learn(numbered.dictionary, numbers.to_numpy())
        self._again[first.to_numpy()[twice]] = True
        (at,) = np.nonzero(cut.to_numpy(zero_copy_only=False))
        ids, place = self.ids.take(first), np.arange(len(units))
        place[at] = len(units) + np.arange(len(at))
        behind = pc.binary_join_element_wise(ids.take(pa.array(at)), self.ids.take(second), pa.scalar(b"", pa.large_binary()))
        return pa.concat_arrays([ids, behind]), place

    def _learn(self, parts: pa.Array, met: np.ndarray) -> None:
        """Make the ids of the parts behind those of the table."""
        known = len(self.parts)
        new = (_strings(parts[a: a + MADE]) for a in range(known, len(parts), MADE))
        self.ids = pa.concat_arrays([self.ids, *(pa.array(self._make_many(strings), pa.large_binary()) for strings in new)])
        self.parts, self._again = parts, np.r_[self._again, np.zeros(len(parts) - known, bool)]
        self._again[met[met < known]] = True

    def _forget(self) -> None:
        length = pc.binary_length(self.parts).to_numpy()
        keep = length <= LONG_UNIT
        size = PART_BYTES + length + pc.binary_length(self.ids).to_numpy()
        if size[keep].sum() > self._most:
            keep &= self._again
            newer = np.cumsum((size * keep)[::-1])[::-1]
            keep &= newer <= self._most // 2
            self._again[:] = False
        if not keep.all():
            kept = pa.array(keep)
            self.parts, self.ids, self._again = self.parts.filter(kept), self.ids.filter(kept), self._again[keep]
