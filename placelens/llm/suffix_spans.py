"""Removal of long repeated word spans with suffix automata.

A span of ``length`` words is removed where it also starts in a document with a smaller id. The reference
of each document is all smaller documents, which grows with the input; so no automaton of everything is
sent to all. Instead the reference is cut into shards that can matter to the same spans: of all runs of
``GRAM`` words in a span the one of smallest hash is its anchor, equal spans have equal anchors, and the
piece of text around an anchor that holds all spans with it is a region. The regions of an anchor are a
shard; its automaton is built region by region in ascending order of ids, and each region first streams
through it for its matching statistics: where the longest match reaches ``length``, the span goes.

Only anchors that two different texts share are looked at, equal regions of a shard count once (of the
others, those with larger ids go whole), and documents of equal words are decided at once: all but the
first go whole. A shard with more than ``SHARD_REGIONS`` different regions is not one task's work: its
spans are grouped by the hash of all their words instead and the smallest id of each is taken.

Defined results: null and empty texts have no words; null ids count as the largest; rows of equal ids
are not each other's reference; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, written
from .words import GramHashes, word_hashes, words_of

LENGTH = 50
GRAM = 26
SHARD_REGIONS = 5_000
_LAST_ID = (1 << 63) - 1


class SuffixAutomaton:
    """All runs of words of the sequences added so far."""

    def __init__(self) -> None:
        self._next: list[dict] = [{}]
        self._link = [-1]
        self._length = [0]

    def add(self, sequence: list) -> None:
        step, link, length = self._next, self._link, self._length
        last = 0
        for word in sequence:
            known = step[last].get(word)
            if known is not None:
                last = known if length[known] == length[last] + 1 else self._clone(last, known, word)
                continue
            new = len(length)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            at = last
            while at >= 0 and word not in step[at]:
                step[at][word] = new
                at = link[at]
            if at >= 0:
                known = step[at][word]
                link[new] = known if length[known] == length[at] + 1 else self._clone(at, known, word)
            last = new

    def _clone(self, at: int, known: int, word) -> int:
        step, link, length = self._next, self._link, self._length
        copy = len(length)
        step.append(dict(step[known]))
        link.append(link[known])
        length.append(length[at] + 1)
        link[known] = copy
        while at >= 0 and step[at].get(word) == known:
            step[at][word] = copy
            at = link[at]
        return copy

    def matching_statistics(self, sequence: list) -> list[int]:
        """For each place, how many words up to and with it are a run of a sequence added before."""
        step, link, length = self._next, self._link, self._length
        at, matched, out = 0, 0, []
        for word in sequence:
            while at and word not in step[at]:
                at = link[at]
                matched = length[at]
            following = step[at].get(word)
            if following is None:
                at, matched = 0, 0
            else:
                at, matched = following, matched + 1
            out.append(matched)
        return out


def _key(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [words_of(text, lower=False) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"), pa.array([len(w) for w in texts], pa.int64()),
                pa.array([_key(w) for w in texts], pa.int64()), pa.array([_sha(w) for w in texts]),
            ],
            names=["id", "n_words", "key", "sha"],
        )


def anchors(words: list[bytes], length: int, gram: int, hashes: GramHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of spans with the same anchor: the anchor's hash, the first span, how many spans."""
    if len(words) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = hashes(word_hashes(words))
    inside = length - gram + 1
    views = np.lib.stride_tricks.sliding_window_view(grams, inside)
    at = np.arange(len(views)) + views.argmin(axis=1)
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return grams[at[start]].view(np.int64), start, np.diff(np.r_[start, len(at)])


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = GramHashes(gram)
        for batch in batches:
            seen, keys, found = set(), [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text, lower=False)
                if len(words) < length or (key := _key(words)) in seen:
                    continue
                seen.add(key)
                found.append(np.unique(anchors(words, length, gram, hashes)[0]))
                keys.append(key)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([*found, np.empty(0, np.int64)])),
                    pa.array(np.repeat(np.array(keys, np.int64), [len(x) for x in found])),
                ],
                names=["anchor", "key"],
            )

    return run


def _regions(length: int, gram: int):
    """Regions around the shared anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = GramHashes(gram)
        for batch in batches:
            rows = {c: [] for c in ("anchor", "content", "key", "id", "start", "spans", "text")}
            size = 0
            for key, doc_id, text, shared in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "text", "anchors")), strict=True):
                words = words_of(text, lower=False)
                if _key(words) != key:
                    continue  # another row of the same id
                anchor, start, spans = anchors(words, length, gram, hashes)
                for k in np.flatnonzero(np.isin(anchor, np.array(shared, np.int64))).tolist():
                    a, n = int(start[k]), int(spans[k])
                    content = b" ".join(words[a: a + n + length - 1])
                    for c, x in zip(rows, (int(anchor[k]), xxhash.xxh3_64_intdigest(content) - (1 << 63), key, doc_id, a, n, content), strict=True):
                        rows[c].append(x)
                    size += len(content)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pydict(rows, _REGION)
                    rows, size = {c: [] for c in rows}, 0
            yield pa.RecordBatch.from_pydict(rows, _REGION)

    return run


_REGION = pa.schema([
    ("anchor", pa.int64()), ("content", pa.int64()), ("key", pa.int64()), ("id", pa.int64()), ("start", pa.int64()),
    ("spans", pa.int64()), ("text", pa.binary()),
])
_REGION_DDL = "anchor long, content long, key long, id long, start long, spans long, text binary"


def shard_matches(regions: list[tuple[int, int, bytes]], length: int) -> Iterator[tuple[int, list[int]]]:
    """(content, offsets of its spans that a region of a smaller id holds), for regions of one anchor
    given as (id, content, words) in ascending order of ids."""
    automaton, waiting, waiting_id = SuffixAutomaton(), [], None
    for doc_id, content, text in regions:
        words = text.split(b" ")
        if doc_id != waiting_id:
            for other in waiting:
                automaton.add(other)
            waiting, waiting_id = [], doc_id
        matched = automaton.matching_statistics(words)
        yield content, [k - length + 1 for k, m in enumerate(matched) if m >= length]
        waiting.append(words)


def _matches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = {"anchor": [], "content": [], "offsets": []}

        def flush(anchor, regions) -> None:
            for content, offsets in shard_matches(regions, length):
                if offsets:
                    out["anchor"].append(anchor)
                    out["content"].append(content)
                    out["offsets"].append(offsets)

        schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("offsets", pa.list_(pa.int64()))])
        anchor, regions = None, []
        for batch in batches:
            for a, doc_id, content, text in zip(*(batch.column(c).to_pylist() for c in ("anchor", "id", "content", "text")), strict=True):
                if a != anchor:
                    flush(anchor, regions)
                    anchor, regions = a, []
                regions.append((doc_id, content, text))
            if len(out["anchor"]) > 10_000:
                yield pa.RecordBatch.from_pydict(out, schema)
                out.update(anchor=[], content=[], offsets=[])
        flush(anchor, regions)
        yield pa.RecordBatch.from_pydict(out, schema)

    return run


def _spans(length: int):
    """The single spans of regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"anchor": [], "content": [], "id": [], "offset": [], "span": []}
            for anchor, content, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "id", "text")), strict=True):
                words = text.split(b" ")
                for k in range(len(words) - length + 1):
                    span = xxhash.xxh3_128_digest(b" ".join(words[k: k + length]))
                    for c, x in zip(rows, (anchor, content, doc_id, k, span), strict=True):
                        rows[c].append(x)
            yield pa.RecordBatch.from_pydict(rows, pa.schema([(c, pa.binary() if c == "span" else pa.int64()) for c in rows]))

    return run


def _cut(length: int):
    """What is left of the documents that lose something: (key, n_removed, sha, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"key": [], "n_removed": [], "sha": [], "kept": []}
            for key, text, cuts in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "cuts")), strict=True):
                words = words_of(text, lower=False)
                edges = np.zeros(len(words) + 1, np.int64)
                for a, b in np.array(cuts, np.int64).reshape(-1, 2):
                    edges[a] += 1
                    edges[b] -= 1
                gone = np.cumsum(edges[:-1]) > 0
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rows["key"].append(key)
                rows["n_removed"].append(int(gone.sum()))
                rows["sha"].append(_sha(kept))
                rows["kept"].append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_pydict(
                rows, pa.schema([("key", pa.int64()), ("n_removed", pa.int64()), ("sha", pa.string()), ("kept", pa.string())])
            )

    return run


def _lost(regions: DataFrame, length: int, shard_regions: int) -> DataFrame:
    """(key, start, stop): runs of words that go, of the first document of each text."""
    distinct = regions.groupBy("anchor", "content").agg(
        F.min("id").alias("least"), F.min(F.struct("id", "key", "start")).alias("at")
    )
    sizes = distinct.groupBy("anchor").agg(F.count("*").alias("regions"))
    several = written(
        distinct.join(sizes.where("regions > 1"), "anchor").select(
            "anchor", "content", F.col("at.key").alias("key"), F.col("at.start").alias("start"), F.col("least").alias("id"), "regions"
        ),
        "region-classes",
    )
    texts = several.join(regions.select("anchor", "content", "key", "start", "text"), ["anchor", "content", "key", "start"])
    texts = texts.select("anchor", "content", "id", "regions", "text")
    small = (
        texts.where(F.col("regions") <= shard_regions).repartition("anchor").sortWithinPartitions("anchor", "id", "content")
        .mapInArrow(_matches(length), "anchor long, content long, offsets array<long>")
    )
    spans = texts.where(F.col("regions") > shard_regions).mapInArrow(
        _spans(length), "anchor long, content long, id long, offset long, span binary"
    )
    firsts = spans.groupBy("span").agg(F.min("id").alias("first_id"))
    large = spans.join(firsts, "span").where("first_id < id").groupBy("anchor", "content").agg(F.collect_list("offset").alias("offsets"))
    offsets = small.unionByName(large)
    verdicts = written(
        distinct.select("anchor", "content", "least").join(offsets, ["anchor", "content"], "left"), "region-verdicts"
    )
    one = F.array(F.struct(F.col("start"), (F.col("start") + F.col("spans") + length - 1).alias("stop")))
    some = F.transform("offsets", lambda k: F.struct((F.col("start") + k).alias("start"), (F.col("start") + k + length).alias("stop")))
    # the only join that carries all regions: where one content is frequent, Spark splits its rows
    judged = regions.select("anchor", "content", "key", "id", "start", "spans").join(verdicts, ["anchor", "content"])
    return judged.select("key", F.inline(F.when(F.col("id") > F.col("least"), one).otherwise(some)))


def repeated_spans_cut(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM,
    shard_regions: int = SHARD_REGIONS,
) -> DataFrame:
    """One row per input row: (doc_id, n_words, n_removed, kept_sha256, kept); ``kept`` holds the words
    that are left of a document that lost something, else null."""
    ship(docs.sparkSession)
    source = docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LAST_ID)).alias("id"), F.col(f"`{text}`").alias("text")
    )
    sized = written(source.mapInArrow(_sized, "id long, n_words long, key long, sha string"), "word-counts")
    firsts = sized.where(F.col("n_words") >= length).groupBy("key").agg(F.min("id").alias("id"))
    rows = source.select("text").mapInArrow(_anchor_rows(length, gram), "anchor long, key long").repartition("anchor")
    shared = rows.groupBy("anchor").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi")
    by_text = rows.join(shared.select("anchor"), "anchor").groupBy("key").agg(F.collect_set("anchor").alias("anchors"))
    wanted = by_text.join(firsts, "key")
    held = written(source.join(wanted, "id").select("key", "id", "text", "anchors"), "shared-texts")
    regions = written(held.mapInArrow(_regions(length, gram), _REGION_DDL), "regions", "zstd")
    lost = _lost(regions.dropDuplicates(["key", "start"]), length, shard_regions)
    cuts = lost.groupBy("key").agg(F.flatten(F.collect_list(F.array("start", "stop"))).alias("cuts"))
    cut = held.select("key", "text").join(cuts, "key").mapInArrow(
        _cut(length), "key long, n_removed long, sha string, kept string"
    ).dropDuplicates(["key"])
    out = sized.join(firsts.select("key", F.col("id").alias("first_id")), "key", "left").join(
        cut.select("key", "n_removed", F.col("sha").alias("cut_sha"), "kept"), "key", "left"
    )
    again = F.col("id") > F.col("first_id")
    return out.select(
        F.when(F.col("id") != _LAST_ID, F.col("id")).alias("doc_id"), "n_words",
        F.when(again, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(again, F.lit(_sha([]))).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(again, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )
