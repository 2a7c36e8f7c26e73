"""Exact cosine search and closest pairs that skip what cannot win: cells around pivots.

Rows go to the cell of their nearest pivot. With ``t`` the angle from a query to the pivot and ``r`` the
largest angle from the pivot to a row of its cell, no row of the cell is more similar than
``cos(max(0, t - r))``. A cell whose bound is under what the query has already found is not visited, and
rows of cells that nothing visits are never copied. Results equal those of the full grid; how much is
saved depends on how far the vectors group, and is reported.

Null vectors take no part. Zero vectors, whose similarity with everything is 0, have a cell of their own.
What reaches the driver is bounded by ``PIVOTS``: pivots, one radius, size and number of visits a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import blocks

PIVOTS = 512
#: Pivots are chosen among this many rows for each pivot.
CANDIDATES = 4
#: Copies of queries that a task makes at a time.
VISITS = 4096
#: Queries of a block that are compared with the other block at a time.
AT_ONCE = 128
#: Angles are allowed this error: an arc cosine near 1 is exact to about 2e-8.
MARGIN = 2e-7


class Cells(NamedTuple):
    rows: DataFrame  # the rows with ``_cell``
    pivots: np.ndarray  # unit vectors, at last a zero vector: the cell of the rows without a direction
    radius: np.ndarray  # largest angle from a pivot to a row of its cell
    size: np.ndarray  # rows of a cell


class Found(NamedTuple):
    rows: DataFrame
    compared: int  # pairs of rows whose similarity was worked out
    grid: int  # pairs that a full grid works out


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _bound(angle: np.ndarray, reach: np.ndarray) -> np.ndarray:
    return np.cos(np.maximum(0.0, angle - reach - MARGIN)) + 1e-11


def _spread(unit: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows, each the farthest from those before it."""
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < n:
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def build(df: DataFrame, row_id: str, vector: str, n_pivots: int | None = None) -> Cells | None:
    """Cells of all rows with a vector; None without any. About the square root of the rows as pivots."""
    spark = df.sparkSession
    present = df.where(F.col(vector).isNotNull())
    n = present.count()
    if not n:
        return None
    m = min(n_pivots or int(np.ceil(np.sqrt(n))), PIVOTS, n)
    sample = present.select(vector).orderBy(F.xxhash64(row_id), row_id).limit(m * CANDIDATES).toArrow()
    unit = blocks.unit_matrix(sample, vector)
    some = unit[unit.any(axis=1)]
    chosen = _spread(some, min(m, len(some))) if len(some) else some
    pivots = np.vstack([chosen, np.zeros((1, unit.shape[1]))])
    sent = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = blocks.unit_matrix(pa.Table.from_batches([batch]), vector)
            angle = _angles(unit, sent.value)
            # pi: farther than any pivot, and a reach that allows for all if there is no other
            angle[:, -1] = np.where(unit.any(axis=1), np.pi, 0.0)
            cell = angle.argmin(axis=1)
            near = angle[np.arange(len(cell)), cell]
            columns = [*batch.columns, pa.array(cell.astype("int32")), pa.array(near)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_cell", "_angle"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in present.schema)
    rows = written(present.mapInArrow(place, f"{schema}, _cell int, _angle double"), "cells")
    sent.unpersist()
    radius, size = np.zeros(len(pivots)), np.zeros(len(pivots), dtype="int64")
    for r in rows.groupBy("_cell").agg(F.max("_angle").alias("r"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["_cell"]], size[r["_cell"]] = r["r"], r["n"]
    return Cells(rows.drop("_angle"), pivots, radius, size)


def _home(angle: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Mask of each query's nearest cells that together hold ``k`` rows."""
    order = np.argsort(angle, axis=1, kind="stable")
    before = np.cumsum(size[order], axis=1) - size[order]
    mask = np.zeros(angle.shape, dtype=bool)
    np.put_along_axis(mask, order, before < k, axis=1)
    return mask & (size > 0)


def _copies(table: pa.Table, row: np.ndarray, cell: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows with their cells, some at a time: there may be hundreds of copies of each row of a table."""
    for at in range(0, len(row), VISITS):
        some = table.take(row[at : at + VISITS])
        yield from some.append_column("_cell", pa.array(cell[at : at + VISITS].astype("int32"))).to_batches()


def _visits(queries: DataFrame, vector: str, cells: Cells, k: int, first: bool) -> DataFrame:
    """A copy of each query for each cell it visits: the nearest ones, or (not ``first``) all others whose
    bound reaches the query's ``_least``."""
    sent = queries.sparkSession.sparkContext.broadcast((cells.pivots, cells.radius, cells.size))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius, size = sent.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            angle = _angles(blocks.unit_matrix(table, vector), pivots)
            mask = _home(angle, size, k)
            if not first:
                least = table.column("_least").to_numpy()[:, None]
                mask = ~mask & (size > 0) & (_bound(angle, radius) >= least)
            row, cell = np.nonzero(mask)
            yield from _copies(table, row, cell)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    return written(queries.mapInArrow(choose, f"{schema}, _cell int"), "visits")


def _block(key: str, n: str) -> Column:
    return F.pmod(F.xxhash64(key), F.col(n)).cast("int")


def _every(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))


def search(
    queries: DataFrame,
    targets: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_vector: str = "embedding",
    target_id: str = "row_id",
    target_vector: str = "embedding",
    payload: tuple[str, ...] = (),
    n_pivots: int | None = None,
    left_block: int = blocks.LEFT_BLOCK,
    right_block: int = blocks.RIGHT_BLOCK,
) -> Found:
    """The ``k`` most similar targets of each query, as ``cosine_search`` finds them (ties to the smaller id).

    First each query meets its nearest cells that hold ``k`` rows together. The k-th similarity found
    there decides which other cells it has to visit. Large cells and cells with many visitors are cut into
    blocks, so no task holds more than two blocks.
    """
    kept = [target_id, *payload]
    asked = queries.where(F.col(query_vector).isNotNull()).select(query_id, F.col(query_vector).alias("_asked"))
    right = targets.select(*kept, F.col(target_vector).alias("_target"))
    named = [(query_id, asked.schema[query_id]), *((c, right.schema[c]) for c in kept)]
    schema = ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in named) + ", similarity double"
    spark = queries.sparkSession
    cells = build(right, target_id, "_target", n_pivots)
    if cells is None:
        return Found(spark.createDataFrame([], f"{schema}, rank int"), 0, 0)
    nothing = blocks._arrow_schema(asked, schema).empty_table()
    best = Window.partitionBy(query_id).orderBy(F.desc("similarity"), target_id)
    compared = 0

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return nothing
        b = blocks.sort_by(b, target_id)
        found = []
        for at in range(0, a.num_rows, AT_ONCE):
            some = a.slice(at, AT_ONCE)
            scores = blocks.cosine(some, b, "_asked", "_target")
            mask = blocks.best_k(scores, k) & (scores >= some.column("_least").to_numpy()[:, None])
            found.append(blocks.emit(some.select([query_id]), b.select(kept), mask, {"similarity": scores}))
        return pa.concat_tables(found)

    def compare(visits: DataFrame) -> DataFrame:
        nonlocal compared
        counts = {r["_cell"]: r["n"] for r in visits.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        compared += sum(n * int(cells.size[c]) for c, n in counts.items())
        cuts = [(c, -(-n // left_block), -(-int(cells.size[c]) // right_block)) for c, n in counts.items()]
        plan = F.broadcast(spark.createDataFrame(cuts, "_cell int, _nl long, _nr long"))  # PIVOTS rows at most
        lhs = visits.join(plan, "_cell").select(
            "_cell", query_id, "_asked", "_least", _block(query_id, "_nl").alias("_lb"), _every("_nr").alias("_rb")
        )
        rhs = cells.rows.join(plan, "_cell").select(
            "_cell", *kept, "_target", _block(target_id, "_nr").alias("_rb"), _every("_nl").alias("_lb")
        )
        key = ["_cell", "_lb", "_rb"]
        return written(lhs.groupBy(*key).cogroup(rhs.groupBy(*key)).applyInArrow(kernel, schema), "near")

    near = compare(_visits(asked.withColumn("_least", F.lit(-2.0)), "_asked", cells, k, True))
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    least = ranked.where(F.col("rank") == k).select(query_id, F.col("similarity").alias("_least"))
    again = asked.join(least, query_id, "left").na.fill(-2.0, ["_least"])
    rest = compare(_visits(again, "_asked", cells, k, False))
    merged = ranked.drop("rank").unionByName(rest)
    found = merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return Found(found, compared, asked.count() * int(cells.size.sum()))


def closest_pairs(
    profiles: DataFrame,
    k: int = 10,
    entity: str = "Town",
    vector: str = "profile",
    n_pivots: int | None = None,
    block: int = blocks.LEFT_BLOCK,
) -> Found:
    """The ``k`` most similar unordered pairs, as ``most_similar_pairs`` finds them.

    Pairs of cells are met in the order of their bounds, in rounds that double. The k-th similarity
    found so far rises from round to round, and the first pair of cells under it ends the search. No pair
    of rows is met from both sides. Entities are unique and not null.
    """
    kind = profiles.schema[entity].dataType.simpleString()
    schema = f"entity_a {kind}, entity_b {kind}, similarity double"
    spark = profiles.sparkSession
    cells = build(profiles.select(F.col(entity).alias("_name"), F.col(vector).alias("_vector")), "_name", "_vector", n_pivots)
    if cells is None:
        return Found(spark.createDataFrame([], schema), 0, 0)
    nothing = blocks._arrow_schema(profiles, schema).empty_table()
    a, b = np.triu_indices(len(cells.size))
    bound = _bound(_angles(cells.pivots, cells.pivots)[a, b], cells.radius[a] + cells.radius[b])
    bound[a == b] = 1.0 + 1e-11
    work = np.where(a == b, cells.size[a] * (cells.size[a] - 1) // 2, cells.size[a] * cells.size[b])
    order = np.argsort(-bound, kind="stable")
    order = order[work[order] > 0]

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return nothing
        names = np.array(left.column("_name").to_pylist() + right.column("_name").to_pylist(), dtype=object)
        place = np.unique(names, return_inverse=True)[1]
        mine, other = place[: left.num_rows, None], place[None, left.num_rows :]
        scores = blocks.cosine(left, right, "_vector", "_vector")
        if left.column("_own")[0].as_py():  # one block with itself
            scores[mine >= other] = -np.inf
        room = min(k, int(np.isfinite(scores).sum()))
        if not room:
            return nothing
        edge = np.partition(scores, scores.size - room, axis=None)[scores.size - room]
        row, column = np.nonzero(scores >= edge)
        low, high = np.minimum(mine[row, 0], other[0, column]), np.maximum(mine[row, 0], other[0, column])
        first = np.lexsort((high, low, -scores[row, column]))[:k]
        texts = np.unique(names)
        return pa.table(
            [
                pa.array(texts[low[first]].tolist(), nothing.schema.field("entity_a").type),
                pa.array(texts[high[first]].tolist(), nothing.schema.field("entity_b").type),
                pa.array(scores[row, column][first]),
            ],
            names=["entity_a", "entity_b", "similarity"],
        )

    def compare(chosen: np.ndarray) -> DataFrame:
        cut = -(-cells.size // block)
        pairs = [(int(a[i]), int(b[i]), int(cut[a[i]]), int(cut[b[i]])) for i in chosen]
        plan = F.broadcast(spark.createDataFrame(pairs, "_a int, _b int, _na long, _nb long"))  # PIVOTS^2 / 2 at most
        own = (F.col("_a") == F.col("_b")) & (F.col("_i") == F.col("_j"))
        once = (F.col("_a") < F.col("_b")) | (F.col("_i") <= F.col("_j"))
        lhs = cells.rows.join(plan, F.col("_cell") == F.col("_a")).select(
            "_a", "_b", "_name", "_vector", _block("_name", "_na").alias("_i"), _every("_nb").alias("_j")
        )
        rhs = cells.rows.join(plan, F.col("_cell") == F.col("_b")).select(
            "_a", "_b", "_name", "_vector", _block("_name", "_nb").alias("_j"), _every("_na").alias("_i")
        )
        key = ["_a", "_b", "_i", "_j"]
        # new names for one side: both come from the same rows
        lhs, rhs = lhs.where(once).withColumn("_own", own), rhs.where(once).toDF(*rhs.columns)
        return lhs.groupBy(*key).cogroup(rhs.groupBy(*key)).applyInArrow(kernel, schema)

    ranking = [F.desc("similarity"), "entity_a", "entity_b"]
    held = spark.createDataFrame([], schema)
    compared, start, take, total = 0, 0, max(1, len(order) // 16), int(work.sum())
    while start < len(order):
        chosen = order[start : start + take]
        best = held.unionByName(compare(chosen)).orderBy(*ranking).limit(k).collect()  # k rows
        held = spark.createDataFrame(best, schema)
        compared += int(work[chosen].sum())
        start, take = start + take, take * 2
        if len(best) == k and start < len(order):
            start = start if bound[order[start]] >= best[-1]["similarity"] else len(order)
    return Found(held.orderBy(*ranking), compared, total)
