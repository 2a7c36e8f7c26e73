"""Sharding by histogram sort.

The rows are ordered by a key of two longs. Each round counts, in all partitions, the exact bytes
below candidate key boundaries (probes); brackets around each wanted splitter shrink to the keys that
the counts leave possible, until the bytes below a splitter meet the tolerance. Then the rows move once,
to the range they belong to, and are sorted and written there.

Shards are unions of neighbouring ranges; the number of ranges follows the input, so that a task gets a
bounded share. A key group that is larger than the tolerance is cut at its second long; rows equal in
both longs are dealt over the ranges that their bytes span.

Defined results: null texts have no bytes; repeated rows count as rows; an empty table gives an empty
table; other columns of any name are carried in ``row``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..session import ship, written

ROW_BYTES = 16
TOLERANCE = 0.002  # of a shard's share, on either side of a splitter
RANGE_BYTES = 128 << 20
MOST_RANGES = 20_000  # bounds what the driver holds; beyond it, ranges get larger
PROBES = 16  # for each open splitter and round
_BIAS = 1 << 63
_SPAN = 1 << 64


def _pack(high: int, low: int) -> int:
    return (high + _BIAS) * _SPAN + low + _BIAS


def _unpack(key: int) -> tuple[int, int]:
    return key // _SPAN - _BIAS, key % _SPAN - _BIAS


def interval_of(high: np.ndarray, low: np.ndarray, probes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many probes are at or below each key; probes are sorted pairs."""
    first = np.searchsorted(probes[0], high, "left")
    last = np.searchsorted(probes[0], high, "right")
    for value in np.unique(high[first < last]):
        rows = high == value
        a, b = np.searchsorted(probes[0], value, "left"), np.searchsorted(probes[0], value, "right")
        first[rows] = a + np.searchsorted(probes[1][a:b], low[rows], "right")
    return first


def _as_arrays(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    pairs = [_unpack(k) for k in keys]
    return (np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64))


def _counter(probes: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            high, low, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("high", "low", "size"))
            at = interval_of(high, low, probes)
            order = np.lexsort((low, high, at))
            at, high, low, size = at[order], high[order], low[order], size[order]
            start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            stop = np.r_[start[1:], len(at)] - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.astype(np.int64)) for x in (
                    at[start], np.add.reduceat(size, start), high[start], low[start], high[stop], low[stop])],
                names=["at", "bytes", "h0", "l0", "h1", "l1"],
            )

    return run


def _counts(keys: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int]]:
    """By interval: bytes, smallest and largest key. At most one more row than there are probes."""
    rows = (
        keys.mapInArrow(_counter(_as_arrays(probes)), "at long, bytes long, h0 long, l0 long, h1 long, l1 long")
        .groupBy("at")
        .agg(F.sum("bytes").alias("bytes"), F.min(F.struct("h0", "l0")).alias("lo"), F.max(F.struct("h1", "l1")).alias("hi"))
        .collect()
    )
    return {r["at"]: (r["bytes"], _pack(*r["lo"]), _pack(*r["hi"])) for r in rows}


def find_splitters(
    keys: DataFrame, ranges: int, tolerance_bytes: float, probes: int = PROBES
) -> list[tuple[int, int, int, int | None]]:
    """For each inner boundary (key, bytes below the key, bytes wanted below the boundary, None).

    Where only the rows of one key lie around a boundary and neither end meets the tolerance, the
    last entry is the number of bytes below the end of those rows.
    """
    whole = _counts(keys, [])
    if not whole:
        return []
    total, low, high = whole[0]
    wanted = [round(total * k / ranges) for k in range(1, ranges)]
    found: dict[int, tuple[int, int, int | None]] = {}
    # bracket: (smallest key that may be the splitter, bytes below it, largest key below the end, bytes below the end)
    open_ = {k: (low, 0, high, total) for k in range(len(wanted))}
    while open_:
        asked: set[int] = set()
        for lo, _, hi, _ in open_.values():
            asked.update(lo + (hi - lo) * i // (probes + 1) for i in range(1, probes + 1))
            asked.update((lo, hi, min(hi + 1, _SPAN * _SPAN - 1)))
        points = sorted(asked)
        counted = _counts(keys, points)
        below, sums = 0, []
        for at in range(len(points) + 1):
            sums.append(below)  # bytes below the interval's start
            below += counted.get(at, (0,))[0]
        for k, (lo, _, hi, _) in list(open_.items()):
            first, last = bisect_right(points, lo), bisect_right(points, hi)
            at = max(first, min(last, bisect_right(sums, wanted[k]) - 1))
            while at not in counted and at > first:
                at -= 1
            size, lo, hi = counted[at]
            start, end = sums[at], sums[at] + size
            edges = [(abs(start - wanted[k]), lo, start), (abs(end - wanted[k]), min(hi + 1, _SPAN * _SPAN - 1), end)]
            miss, key, has = min(edges)
            if miss <= tolerance_bytes or lo == hi:
                found[k] = (lo, start, end) if miss > tolerance_bytes else (key, has, None)
                del open_[k]
            else:
                open_[k] = (lo, start, hi, end)
    return [(found[k][0], found[k][1], wanted[k], found[k][2]) for k in range(len(wanted))]


def _range_udf(splitters: list[tuple[int, int, int, int | None]], tied: set[int]):
    """Range of each row. ``tied``: keys of several equal rows that a boundary lies among; these rows
    are dealt by chance in proportion to the bytes on each side."""
    plain, cuts = [], {}
    for key, below, wanted, end in splitters:
        after = end is not None and (key in tied or end - wanted < wanted - below)
        plain.append(key + after)
    for key, below, wanted, end in splitters:
        if end is not None and key in tied:
            first = sum(p <= key for p in plain)
            cuts.setdefault(_unpack(key), (first, []))[1].append((wanted - below) / (end - below))
    edges = _as_arrays(plain)

    @F.pandas_udf(IntegerType())
    def udf(high, low, chance):
        import pandas as pd

        h, l, u = high.to_numpy(np.int64), low.to_numpy(np.int64), chance.to_numpy(float)
        out = interval_of(h, l, edges)
        for (a, b), (first, shares) in cuts.items():
            rows = (h == a) & (l == b)
            if rows.any():
                out[rows] = first + np.searchsorted(np.array(shares), u[rows], "right")
        return pd.Series(out.astype(np.int32))

    return udf


def histogram_shards(
    df: DataFrame,
    shards: int,
    high: Column,
    low: Column,
    size: Column,
    tolerance: float = TOLERANCE,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Columns ``row`` (the input row), ``size``, ``shard`` and ``slot`` (gapless from 0 in each shard)
    of the table written in shard order; ``high`` and ``low`` are the key, not null."""
    ship(df.sparkSession)
    keyed = df.select(
        high.cast("long").alias("high"), low.cast("long").alias("low"), size.cast("long").alias("size"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
    )
    keys = written(keyed.select("high", "low", "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, min(-(-total // (shards * range_bytes)), MOST_RANGES // shards))
    ranges = shards * per_shard
    splitters = find_splitters(keys, ranges, tolerance * total / shards)
    among = sorted({k for k, _, _, end in splitters if end is not None})  # no more than there are ranges
    tied = set()
    if among:
        pairs = df.sparkSession.createDataFrame([_unpack(k) for k in among], "high long, low long")
        many = keys.join(F.broadcast(pairs), ["high", "low"]).groupBy("high", "low").count().where("count > 1")
        tied = {_pack(r["high"], r["low"]) for r in many.collect()}
    to_range = _range_udf(splitters, tied)
    moved = (
        keyed.withColumn("range", to_range("high", "low", F.rand(7)))
        .repartitionById(ranges, F.col("range"))
        .sortWithinPartitions("high", "low")
        .select("row", "size", "range", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"))
    )
    table = written(moved, "shards").withColumn("shard", F.floor(F.col("range") / per_shard).cast("int"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = table.groupBy("shard", "range").agg(F.count("*").alias("n")).select(
        "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    return table.join(F.broadcast(offsets), "range").select("row", "size", "shard", (F.col("offset") + F.col("pos")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Shards of near-equal bytes. Ordered by a hash of the text, then by id, so that equal texts are
    neighbours and stay in one shard unless the tolerance cuts their group."""
    return histogram_shards(
        docs,
        shards,
        high=F.xxhash64(F.col(f"`{text}`")),
        low=F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-(1 << 63))),
        size=F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)) + ROW_BYTES,
    )
