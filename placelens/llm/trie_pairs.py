"""Spelling variants: words that differ by one letter, found by pairs of trie nodes.

Words are sorted twice, as written and reversed, and the nodes of the two tries are numbered. A word cut
at place i is the pair (node of what stands before, node of what stands behind); leaving out letter i
gives another pair. Two words differ by one replaced letter if they agree in a pair of the second kind, and
by one letter more or less if a pair of the second kind of the longer is one of the first kind of the shorter.
Pairs are two integers, so the join is exact and needs no check of the words. A node that only one word
passes through can be no part of a common pair; such pairs are not made.

A sorted stream needs only the path of the word before to number its nodes. Every task numbers its own range of
words; nodes that reach over the border of two ranges are named by the first of them.

Odd input: rows without text give no words; a missing id reads as "null"; rows that repeat count each
time; an empty table gives no rows; other columns of the documents are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

RUN = "[a-zÀ-ÿ]"  # after lower-casing A-Z
MOST_COUNTED = 300_000  # words a task counts before it sends its counts on
PART_SHIFT = 36  # a number is the task's, then that of a node or word within the task
SKIP, LAST_OF_RUN, FULL = 0, 1, 2  # kinds of a pair; LAST_OF_RUN is a skip, too


def word_counts(docs: DataFrame, min_length: int = 7, min_count: int = 2, noise: int = 0,
                text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n) of the runs of letters of all texts, A-Z lower-cased, of at least ``min_length`` letters and
    ``min_count`` occurrences. With ``noise`` a run loses the letter ``h % length`` where ``noise`` divides h,
    the crc32 of ``<key>:<run>``: misspellings that the key decides."""
    find = re.compile(f"{RUN}{{{min_length},}}").findall

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = content.as_py()
                if not content:
                    continue
                start = zlib.crc32(f"{'null' if name is None else name}:".encode())
                for word, n in Counter(find(content.encode().lower().decode())).items():
                    if noise:
                        h = zlib.crc32(word.encode(), start)
                        if h % noise == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < min_length:
                                continue
                    total[word] = total.get(word, 0) + n
                if len(total) >= MOST_COUNTED:
                    yield _table(total)
                    total = {}
        yield _table(total)

    def _table(total: dict[str, int]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text is not null")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def common_prefix(a: str, b: str) -> int:
    """Length of what both begin with."""
    n, k = min(len(a), len(b)), 0
    while k < n and a[k:k + 256] == b[k:k + 256]:
        k += 256
    while k < n and a[k] == b[k]:
        k += 1
    return min(k, n)


@dataclass
class Edge:
    """What a task's range shares with the range before: the letters, the numbers of their nodes; and the
    letters that its last word shares with the range behind."""

    first: str
    shared: int
    ids: list[int]
    top: int
    shared_behind: int = 0


def _number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the nodes of sorted keys (column ``key``). ``path`` holds the numbers down to the deepest node
    shared with the word before or behind; of the first and last word, all numbers."""
    part = TaskContext.get().partitionId()
    base = part << PART_SHIFT
    made, before, path, at = 0, None, [0], 0
    held: tuple | None = None  # the row whose follower is not known yet

    def out(rows: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        extra = pa.record_batch(
            [pa.array([part] * len(found), pa.int64()), *(pa.array(list(x), pa.int64()) for x in list(zip(*found))[:3]),
             pa.array([x[3] for x in found], pa.list_(pa.int64()))],
            ["part", "at", "before", "after", "path"])
        return pa.RecordBatch.from_arrays([*rows.columns, *extra.columns], [*rows.schema.names, *extra.schema.names])

    for batch in batches:
        found, carry = [], None
        for key in batch.column("key").to_pylist():
            shared = 0 if before is None else common_prefix(before, key)
            if held is not None:
                row = (held[0], held[1], shared, held[2] if held[0] == 0 else held[2][:max(held[1], shared) + 1])
                if held[3]:
                    found.append(row)
                else:
                    carry = row
            path = path[:shared + 1] + list(range(base + made + 1, base + made + 1 + len(key) - shared))
            made += len(key) - shared
            held, before, at = (at, shared, path, True), key, at + 1
        if batch.num_rows:
            if carry is not None:
                yield out(last, [carry])
            if found:
                yield out(batch.slice(0, len(found)), found)
            last, held = batch.slice(batch.num_rows - 1), (*held[:3], False)
    if held is not None:
        yield out(last, [(held[0], held[1], 0, held[2])])


def _numbered(rows: DataFrame, name: str) -> tuple[DataFrame, dict[int, Edge]]:
    """The rows with their paths, sorted by ``key`` in ranges, and the edges of the ranges: one row for each
    task of the sort comes to the driver."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    sorted_rows = rows.repartitionByRange("key").sortWithinPartitions("key")
    table = written(sorted_rows.mapInArrow(_number, schema + ", part long, at long, before long, after long, path array<long>"), name)
    ends = table.groupBy("part").agg(
        F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last"),
        F.max_by("path", "at").alias("path"), F.max("at").alias("top"))
    edges: dict[int, Edge] = {}
    last, last_path = "", [0]
    for row in ends.orderBy("part").collect():
        shared = common_prefix(last, row["first"])
        if edges:
            next(reversed(edges.values())).shared_behind = shared
        edge = edges[row["part"]] = Edge(row["first"], shared, last_path[:shared + 1], row["top"])
        kept = min(shared, common_prefix(row["first"], row["last"]))
        last, last_path = row["last"], edge.ids[:kept + 1] + row["path"][kept + 1:]
    return table, edges


def _settled(batch: pa.RecordBatch, edges: dict[int, Edge]) -> list[list[int]]:
    """The paths of the rows, with the numbers of nodes that other ranges share."""
    columns = [batch.column(name).to_pylist() for name in ("key", "part", "at", "before", "after", "path")]
    paths = []
    for key, part, at, before, after, path in zip(*columns, strict=True):
        edge = edges[part]
        if at == 0:
            before = edge.shared
        if at == edge.top:
            after = edge.shared_behind
        path = path[:max(before, after) + 1]
        if edge.shared:
            common = min(edge.shared, len(path) - 1, common_prefix(key, edge.first))
            path[:common + 1] = edge.ids[:common + 1]
        paths.append(path)
    return paths


def _forward(edges: dict[int, Edge]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = (batch.column("part").to_numpy() << PART_SHIFT) | batch.column("at").to_numpy()
            yield pa.record_batch(
                [batch.column("key"), batch.column("n"), pa.array(rank), pa.array(_settled(batch, edges), pa.list_(pa.int64()))],
                ["word", "n", "rank", "forward"])

    return run


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All elements, where each list begins, and its length."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for path in lists for x in path), np.int64, int(size.sum())), np.cumsum(size) - size, size


def _pairs(edges: dict[int, Edge]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("word").to_pylist()
            length = np.fromiter(map(len, words), np.int64, len(words))
            letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
            letters = np.append(letters, np.uint32(0))
            first_letter = np.cumsum(length) - length
            p, p_at, p_size = _flat(batch.column("forward").to_pylist())
            s, s_at, s_size = _flat(_settled(batch, edges))
            rank, n = batch.column("rank").to_numpy(), batch.column("n").to_numpy()
            for skipped in (1, 0):  # letters between the two nodes
                low = np.maximum(0, length - skipped - (s_size - 1))
                many = np.maximum(0, np.minimum(p_size - 1, length - skipped) - low + 1)
                row = np.repeat(np.arange(len(words)), many)
                i = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + low[row]
                if skipped:
                    here = first_letter[row] + i
                    kind = ((i == length[row] - 1) | (letters[here] != letters[here + 1])).astype(np.int8)
                else:
                    kind = np.full(len(row), FULL, np.int8)
                yield pa.record_batch(
                    [pa.array(p[p_at[row] + i]), pa.array(s[s_at[row] + length[row] - skipped - i]), pa.array(rank[row]),
                     pa.array(n[row]), pa.array(kind)], ["p", "s", "rank", "n", "kind"])

    return run


def near_words(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of distinct ``words`` (word, n): all words with a ``rank`` in code-point order, and for each rank with near
    words their number ``n_near`` and the ``best`` (n, minus rank): the most frequent, then the first.

    Words that agree in a pair differ in one letter at one place, so a group holds no more of them than
    there are letters; groups are never expanded into pairs of words.
    """
    table, edges = _numbered(words.select(F.col("word").alias("key"), "n"), "trie-forward")
    ranked = table.mapInArrow(_forward(edges), "word string, n long, rank long, forward array<long>")
    table, edges = _numbered(ranked.withColumn("key", F.reverse("word")), "trie-reversed")
    pairs = table.mapInArrow(_pairs(edges), "p long, s long, rank long, n long, kind byte")
    member = F.struct("n", (-F.col("rank")).alias("minus"), "kind")
    groups = pairs.groupBy("p", "s").agg(F.sort_array(F.collect_list(member), False).alias("all")).where(F.size("all") > 1)
    groups = groups.select(
        F.filter("all", lambda x: x["kind"] != FULL).alias("skips"),
        F.filter("all", lambda x: x["kind"] == LAST_OF_RUN).alias("removable"),
        F.filter("all", lambda x: x["kind"] == FULL).alias("full"))
    as_best = lambda x: F.struct(x["n"].alias("n"), x["minus"].alias("minus"))
    head = lambda column, k: F.get(column, F.lit(k))

    def of_skip(x):
        other = F.when(head("skips", 0)["minus"] == x["minus"], head("skips", 1)).otherwise(head("skips", 0))
        shorter = F.when(x["kind"] == LAST_OF_RUN, head("full", 0))
        best = F.greatest(F.when(other.isNotNull(), as_best(other)), F.when(shorter.isNotNull(), as_best(shorter)))
        many = F.size("skips") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)
        return F.struct((-x["minus"]).alias("rank"), many.alias("many"), best.alias("best"))

    def of_full(x):
        best = F.when(F.size("removable") > 0, as_best(head("removable", 0)))
        return F.struct((-x["minus"]).alias("rank"), F.size("removable").alias("many"), best.alias("best"))

    found = groups.select(F.explode(F.concat(F.transform("skips", of_skip), F.transform("full", of_full))).alias("x")).select("x.*")
    near = found.where("many > 0").groupBy("rank").agg(F.sum("many").alias("n_near"), F.max("best").alias("best"))
    return table.select("word", "n", "rank"), near


def variant_forms(words: DataFrame, factor: int = 10) -> DataFrame:
    """For each of the distinct ``words`` (word, n): ``n_near``, the number of words that differ by one letter put
    in, left out or replaced; ``form``, the most frequent of them (ties: the first in code-point order), if it
    is at least ``factor`` times as frequent, with its count ``form_n``; and ``root``, where the forms lead to.

    Every form is ``factor`` times as frequent as the word, so chains are short; each round doubles the steps."""
    ranked, near = near_words(words)
    known = written(
        ranked.join(near, "rank", "left").select(
            "rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(F.col("best.n") >= factor * F.col("n"), -F.col("best.minus")).alias("form_rank"),
            F.when(F.col("best.n") >= factor * F.col("n"), F.col("best.n")).alias("form_n")), "trie-near")
    steps = known.where("form_rank is not null").select("rank", F.col("form_rank").alias("root_rank"))
    while True:
        further = steps.select(F.col("rank").alias("root_rank"), F.col("root_rank").alias("further"))
        steps = written(steps.join(further, "root_rank", "left").select(
            "rank", F.coalesce("further", "root_rank").alias("root_rank"), F.col("further").isNotNull().alias("moved")), "trie-roots")
        if steps.where("moved").isEmpty():
            break
        steps = steps.drop("moved")
    names = known.select("rank", "word")
    led = (
        known.where("form_rank is not null").select("rank", "form_rank").join(steps.select("rank", "root_rank"), "rank")
        .join(names.select(F.col("rank").alias("form_rank"), F.col("word").alias("form")), "form_rank")
        .join(names.select(F.col("rank").alias("root_rank"), F.col("word").alias("root")), "root_rank")
        .select("rank", "form", "root"))
    return known.join(led, "rank", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
