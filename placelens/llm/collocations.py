"""Phrases whose words occur together more often than apart, by weighted acyclic automata of counts.

Each task reads its texts in shards, sorts the word sequences of a shard and builds an automaton of them for each
range of phrases. Ranges are sent to one task each, which takes the union of the shards' automata, adding
weights, and gives every phrase that is frequent enough. A phrase that begins another may have counts in two
ranges; those few are given by both and added up. Ranges are cut at whole sequences, so a word or a word pair that
a third of all texts hold is spread over many ranges. Their borders come from a bounded sample of texts and decide
nothing but how evenly the work is spread.

Counts of a phrase's parts come from composing it with the sorted frequent phrases, forward for its first words
and reversed for the rest: on the way to a phrase lie its own beginnings. Every frequent phrase's parts are
frequent themselves. No part is looked up by its own key, so a word that many phrases share makes no hot task.

Odd input: a null text has no words; a null language is ``und``; rows that repeat count each time; an empty
table gives no rows; other columns are not looked at. Words may be of any length.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .count_automata import WIDTH, CountAutomaton, first_at_or_behind, grams_at_every_place

UNKNOWN = "und"
SHARD_PLACES = 1_500_000  # words in a shard; a task holds one
RANGE_PLACES = 1_000_000  # words that begin a sequence of a range, about
MOST_RANGES = 20_000  # their borders go to every task; beyond it, ranges grow
MOST_SAMPLED = 60_000  # texts read for the borders
SPACING = 48  # of the places taken from a sampled text
SLICES = 64
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _BREAKS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_BREAKS))


def tokens(text: str) -> list[bytes]:
    """Words, and a newline behind each piece; empty strings between them mean nothing."""
    return (text.encode().translate(_TABLE).replace(b"\n", b" \n ") + b" \n").split(b" ")


class Shard:
    """Texts of any languages, as numbers of their words."""

    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[b""], self.number[b"\n"] = 0, 1
        self.places, self.texts = 0, defaultdict(list)

    def add(self, lang: str, text: str) -> None:
        found = tokens(text)
        self.texts[lang].append(np.fromiter(map(self.number.__getitem__, found), np.int32, len(found)))
        self.places += len(found)

    def automata(self, borders: list[tuple]) -> Iterator[tuple[int, str, bytes]]:
        """(range, language, automaton) for every range that the shard has sequences of."""
        words = sorted(list(self.number)[2:])
        label = np.zeros(len(words) + 2, np.int64)
        label[np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))] = np.arange(1, len(words) + 1)
        for lang, texts in self.texts.items():
            ids = np.concatenate(texts)
            grams = grams_at_every_place(label[ids[ids != 0]].astype(np.uint32))
            low, high = bisect_left(borders, (lang,)), bisect_left(borders, (lang + "\0",))
            cuts = [0, *(first_at_or_behind(grams, words, b[1]) for b in borders[low:high]), len(grams)]
            for k in range(len(cuts) - 1):
                if cuts[k] < cuts[k + 1]:
                    yield low + k, lang, CountAutomaton.build(grams.part(cuts[k], cuts[k + 1]), words).to_bytes()


def range_borders(docs: DataFrame) -> list[tuple[str, tuple[bytes, ...]]]:
    """Sorted (language, sequence) between which lie about ``RANGE_PLACES`` places each. From every ``spread``-th
    text by hash, at most about ``MOST_SAMPLED``; equal texts are taken once."""
    total = docs.count()
    spread = max(1, total // min(2_000 + total // 1_000, MOST_SAMPLED))

    def sample(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, keys = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [x for x in tokens(text) if x]
                for k in range(len(found) % SPACING, len(found), SPACING):
                    key = found[k:k + WIDTH]
                    key = key[:key.index(b"\n")] if b"\n" in key else key
                    langs.append(lang)
                    keys.append(b" ".join(key))
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(keys, pa.binary())], ["lang", "key"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(spread)) == 0)
    keys = some.mapInArrow(sample, "lang string, key binary").collect()
    ranges = min(MOST_RANGES, max(1, len(keys) * SPACING * spread // RANGE_PLACES))
    ordered = sorted((r["lang"], tuple(bytes(r["key"]).split(b" "))) for r in keys if r["key"])
    if not ordered:
        return []
    return sorted({ordered[k * len(ordered) // ranges] for k in range(1, ranges)})


def shard_automata(docs: DataFrame, borders: list[tuple]) -> DataFrame:
    """(range, lang, automaton) of every shard of (lang, text)."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.add(lang, text.as_py())
                if shard.places >= SHARD_PLACES:
                    yield from out(shard)
                    shard = Shard()
        yield from out(shard)

    def out(shard: Shard) -> Iterator[pa.RecordBatch]:
        for number, lang, content in shard.automata(borders):
            yield pa.record_batch(
                [pa.array([number], pa.int32()), pa.array([lang]), pa.array([content], pa.binary())], ["range", "lang", "automaton"])

    return docs.mapInArrow(build, "range int, lang string, automaton binary")


def frequent_phrases(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """Of (lang, text): (lang, words, f) of all phrases of up to ``WIDTH`` words with ``least`` occurrences or more, and
    (lang, n), the words of each language."""
    borders = range_borders(docs)
    packed = shard_automata(docs, borders)

    def unite(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = key[0].as_py(), defaultdict(list)
        for batch in batches:
            for lang, content in zip(batch.column("lang").to_pylist(), batch.column("automaton").to_pylist(), strict=True):
                own = held[lang]
                own.append(CountAutomaton.from_bytes(content))
                if len(own) >= 64:
                    own[:] = [CountAutomaton.union(own)]
        near = borders[max(0, number - 1):number + 1]
        for lang, automata in held.items():
            whole = CountAutomaton.union(automata)
            shared = {b[1][:k] for b in near if b[0] == lang for k in range(1, len(b[1]) + 1)}
            found = whole.phrases(least, shared)
            yield pa.record_batch(
                [pa.array([lang] * (len(found) + 1)), pa.array([None, *(b" ".join(p).decode() for p, _ in found)], pa.string()),
                 pa.array([whole.places(), *(n for _, n in found)], pa.int64())], ["lang", "phrase", "f"])

    counted = packed.groupBy("range").applyInArrow(unite, "lang string, phrase string, f long")
    summed = written(counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "phrases")
    phrases = summed.where((F.col("f") >= least) & F.col("phrase").isNotNull())
    totals = summed.where("phrase is null").select("lang", F.col("f").alias("n"))
    return phrases.select("lang", F.split("phrase", " ").alias("words"), "f"), totals


def _beginnings(phrases: DataFrame, name: str) -> DataFrame:
    """Adds ``own``: the counts of the phrase's beginnings of 1, 2, ... words, itself not included.

    The phrases stand sorted, and an automaton of them is walked and built at once: what is not yet final is
    the path to the phrase read last, and a phrase's beginnings lie on it. Beginnings that stand in an earlier
    range are at most ``WIDTH - 1`` for each range; they are looked up together."""

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, path, lang_before, at = TaskContext.get().partitionId(), [], None, 0
        for batch in batches:
            found, first = [], at
            for lang, words, f in zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "f")), strict=True):
                k = 0
                if lang == lang_before:
                    while k < len(path) and k < len(words) - 1 and path[k][0] == words[k]:
                        k += 1
                path = path[:k] + [(word, None) for word in words[k:-1]] + [(words[-1], f)]
                found.append([n for _, n in path[:-1]])
                lang_before, at = lang, at + 1
            extra = [pa.array([part] * len(found), pa.int64()), pa.array(np.arange(first, at)), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "part", "at", "own"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in phrases.schema)
    in_order = phrases.repartitionByRange("lang", "words").sortWithinPartitions("lang", "words")
    table = written(in_order.mapInArrow(walk, schema + ", part long, at long, own array<long>"), name)
    firsts = table.groupBy("part").agg(F.min_by(F.struct("lang", "words"), "at").alias("x")).select("x.*").collect()
    wanted = {(r["lang"], tuple(r["words"][:k])) for r in firsts for k in range(1, len(r["words"]))}
    if not wanted:
        return table.drop("part", "at")
    asked = table.sparkSession.createDataFrame([(lang, list(words)) for lang, words in wanted], "lang string, words array<string>")
    known = {(r["lang"], tuple(r["words"])): r["f"] for r in table.join(F.broadcast(asked), ["lang", "words"]).select("lang", "words", "f").collect()}

    place = table.columns.index("own")

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(place).to_pylist()
            for row, counts in enumerate(lists):
                if None in counts:
                    lang, words = batch.column("lang")[row].as_py(), batch.column("words")[row].as_py()
                    lists[row] = [known[lang, tuple(words[:k + 1])] if n is None else n for k, n in enumerate(counts)]
            yield batch.set_column(place, "own", pa.array(lists, pa.list_(pa.int64())))

    return table.mapInArrow(fill, table.schema).drop("part", "at")


def _whole(column: Column) -> Column:
    return column.cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = 30, top: int = 2_000, absorbed: int = 80, scale: int = 2_000_000,
                 text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``top`` phrases of two to ``WIDTH`` words of every language: lang, rank, phrase, a, l, r, n, score.

    ``a`` is the phrase's count, at least ``least``; cut after its first words, ``l`` and ``r`` are the counts of the two
    parts and ``floor(scale * a / (l + r))`` the score; the lowest cut counts, the earliest on ties. ``n`` is the number of words of
    the language. A phrase within a longer one that has ``absorbed`` percent of its count or more is left out: it
    is enough to look at those with one word more, for a longer one's own parts are at least as frequent as it."""
    rows = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").alias("text"))
    phrases, totals = frequent_phrases(rows.where("text is not null"), least)
    forward = _beginnings(phrases, "first-parts").withColumnRenamed("own", "heads")
    reversed_words = forward.select("lang", F.reverse("words").alias("words"), "f", "heads")
    both = written(_beginnings(reversed_words, "last-parts").select(
        "lang", F.reverse("words").alias("words"), F.col("f").alias("a"), "heads", F.col("own").alias("tails")), "parts")
    size = F.size("words")
    candidates = both.where(size >= 2)
    longer = candidates.where(size >= 3).select(
        "lang", "a", F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("words"))
    longest = longer.groupBy("lang", "words").agg(F.max("a").alias("longer"))
    kept = candidates.join(longest, ["lang", "words"], "left").where(
        F.col("longer").isNull() | (_whole(F.col("longer")) * 100 < _whole(F.col("a")) * absorbed))

    def cut(k: Column) -> Column:
        left, right = F.get("heads", k - 1), F.get("tails", size - k - 1)
        score = F.expr(f"CAST({scale} AS DECIMAL(18,0))") * _whole(F.col("a"))
        return F.struct(score.alias("top"), (_whole(left) + _whole(right)).alias("under"), k.alias("k"), left.alias("l"), right.alias("r"))

    cuts = F.transform(F.sequence(F.lit(1), size - 1), cut)
    scored = kept.select("lang", "words", "a", F.explode(cuts).alias("x")).select("lang", "words", "a", "x.*")
    scored = scored.withColumn("score", F.expr("top div under"))
    best = scored.groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    best = best.select("lang", F.array_join("words", " ").alias("phrase"), "a", "x.l", "x.r", "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))
    few = best.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES))).withColumn("place", place).where(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = few.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
