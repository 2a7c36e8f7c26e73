"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gives a neighbour graph, which is cut into balanced parts with few edges between
them. A small network learns, from a vector, how its neighbours are spread over the parts. It places every
vector of the table in its most probable part and sends every query to its several most probable ones, where
all vectors are compared exactly. How many parts a query visits is measured: a set of queries is searched in the
whole table, and the least number that finds ``RECALL`` of their neighbours is taken. A share of the sample, the
pilot, is compared with every query: what is worse than a query's nearest there is not passed on from the parts.

Equal vectors are one class, which keeps as many of its smallest ids as an answer can hold, so a vector that a
third of all rows share costs no more than another. Parts are cut into blocks of bounded size, queries too,
and only the nearest of each pair of blocks are passed on.

Odd input: rows without id or vector, vectors that are zero or hold a null or non-finite component take no part,
nor do those whose length is not the commonest (ties: the smaller). An id that occurs twice is two candidates.
An empty table gives no rows; a table of few vectors is one part, searched whole. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

SAMPLE = 12_000  # vectors on which graph and network are fitted, on the driver
NEIGHBOURS = 12  # of each in the graph
PILOT = 4_096  # of the sample; sent to every task that reads queries
PARTS_PER_ROOT = 0.25  # parts grow with the root of the number of vectors
MOST_PARTS = 256  # each needs its share of the sample; beyond, parts grow and are searched in blocks
IN_PILOT = -1  # the part of its vectors
HIDDEN, EPOCHS, BATCH, RATE = 128, 20, 128, 3e-3
MEASURED, RECALL = 300, 0.97
BLOCK, QUERY_BLOCK = 8_192, 2_048
SALTS = 16
SEED = 17


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the ``k`` others of the largest inner product; rows in blocks."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), np.int64)
    for at in range(0, n, 1024):
        scores = x[at:at + 1024] @ x.T
        scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
        out[at:at + 1024] = np.argpartition(scores, n - k, axis=1)[:, n - k:]
    return out


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Part of each node: sizes near equal, few edges cut. Halves again and again: nodes in the order of a slow
    vector of the random walk on the graph, cut in the middle, then the pairs swapped that cut fewer edges."""
    n, k = graph.shape
    a = np.concatenate((np.repeat(np.arange(n), k), graph.ravel()))
    b = np.concatenate((graph.ravel(), np.repeat(np.arange(n), k)))
    part = np.zeros(n, np.int64)
    work = [(np.arange(n), a, b, 0, parts)]
    while work:
        nodes, a, b, first, many = work.pop()
        if many == 1 or len(nodes) < 2:
            part[nodes] = first
            continue
        place = np.full(n, -1)
        place[nodes] = np.arange(len(nodes))
        u, v = place[a], place[b]
        degree = np.bincount(u, minlength=len(nodes)) + 1.0
        y = rng.standard_normal(len(nodes))
        for _ in range(40):
            y = (np.bincount(u, y[v], minlength=len(nodes)) + y) / degree
            y -= (y * degree).sum() / degree.sum()
            y /= max(np.abs(y).max(), 1e-300)
        left_many = many // 2
        cut = len(nodes) * left_many // many
        left = np.zeros(len(nodes), bool)
        left[np.argsort(y, kind="stable")[:cut]] = True
        for _ in range(8):
            across = np.bincount(u, left[u] != left[v], minlength=len(nodes))
            gain = 2 * across - np.bincount(u, minlength=len(nodes))
            l_best = np.flatnonzero(left)[np.argsort(-gain[left], kind="stable")]
            r_best = np.flatnonzero(~left)[np.argsort(-gain[~left], kind="stable")]
            both = min(len(l_best), len(r_best))
            swap = int((gain[l_best[:both]] + gain[r_best[:both]] > 1).sum()) // 2
            if not swap:
                break
            before = across.sum()
            left[l_best[:swap]], left[r_best[:swap]] = False, True
            if (left[u] != left[v]).sum() >= before:
                left[l_best[:swap]], left[r_best[:swap]] = True, False
                break
        for side, start, count in ((left, first, left_many), (~left, first + left_many, many - left_many)):
            inside = side[u] & side[v]
            work.append((nodes[side], a[inside], b[inside], start, count))
    return part


@dataclass
class Router:
    """A network of one hidden layer: logits of the parts from a vector."""

    centre: np.ndarray
    scale: float
    first: np.ndarray
    first_bias: np.ndarray
    last: np.ndarray
    last_bias: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.centre) / self.scale @ self.first + self.first_bias, 0)
        return hidden @ self.last + self.last_bias

    @property
    def parts(self) -> int:
        return len(self.last_bias)

    @classmethod
    def fit(cls, x: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> Router:
        """Adam on the cross entropy with the shares of the parts among a vector's neighbours and itself."""
        n, wide = x.shape
        share = np.zeros((n, parts))
        np.add.at(share, (np.arange(n)[:, None], part[np.column_stack((np.arange(n), graph))]), 1.0 / (graph.shape[1] + 1))
        centre = x.mean(axis=0)
        scale = float(np.sqrt(((x - centre) ** 2).mean())) or 1.0
        z = (x - centre) / scale
        weights = [rng.standard_normal((wide, HIDDEN)) * np.sqrt(2 / wide), np.zeros(HIDDEN),
                   rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
        mean, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for at in range(0, n, BATCH):
                rows = order[at:at + BATCH]
                hidden = np.maximum(z[rows] @ weights[0] + weights[1], 0)
                out = hidden @ weights[2] + weights[3]
                out = np.exp(out - out.max(axis=1, keepdims=True))
                error = (out / out.sum(axis=1, keepdims=True) - share[rows]) / len(rows)
                back = (error @ weights[2].T) * (hidden > 0)
                step += 1
                for k, g in enumerate((z[rows].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0))):
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    weights[k] -= RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        return cls(centre, scale, *weights)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def vector_classes(table: DataFrame, keep: int, vector: str, key: str) -> DataFrame:
    """(class, vector, ids): each different vector, its smallest id and its ``keep`` smallest ids in order."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists(x, lambda v: v != 0)
    rows = table.select(F.col(key).cast("long").alias("id"), x.alias("vector")).where(
        F.col("id").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("many"))
    usual = sizes.orderBy(F.desc("many"), "size").limit(1).first()
    rows = rows.where(F.size("vector") == (usual["size"] if usual else 0))
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))  # limited in each task before it is sent
    few = rows.withColumn("place", place).where(F.col("place") <= keep)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        F.get("ids", F.lit(0)).alias("class"), "vector", "ids")


@dataclass
class Pilot:
    """Classes that every query is compared with."""

    table: pa.Table  # class, vector, ids

    def best(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, class number and score of the ``k`` nearest of each row."""
        y = matrix(self.table.column("vector"))
        row, c = nearest(x @ y.T, k)
        return row, c, exact_scores(x[row], y[c])

    def floors(self, x: np.ndarray, k: int) -> np.ndarray:
        """Score that the ``k`` nearest of each row reach, less what rounding may change."""
        scores = x @ matrix(self.table.column("vector")).T
        if scores.shape[1] < k:
            return np.full(len(x), -np.inf)
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        return least - 1e-9 * np.abs(scores).max(axis=1)


def fit_router(classes: DataFrame, many: int) -> tuple[Router, Pilot] | None:
    """Router for the parts that ``many`` vectors need, and the pilot; None if one part is enough."""
    parts = min(MOST_PARTS, int(PARTS_PER_ROOT * many**0.5))
    if parts < 2:
        return None
    some = classes.select("class", "vector", "ids").orderBy(F.xxhash64("class"), "class").limit(min(SAMPLE, many)).toArrow()
    x, rng = matrix(some.column("vector")), np.random.default_rng(SEED)
    graph = neighbour_graph(x, NEIGHBOURS)
    pilot = Pilot(some.slice(0, min(PILOT, many // 2)).combine_chunks())
    return Router.fit(x, balanced_parts(graph, parts, rng), graph, parts, rng), pilot


def placed(classes: DataFrame, fitted: tuple[Router, Pilot] | None) -> DataFrame:
    """Every class with its most probable ``part``."""
    router = fitted[0] if fitted else None
    pilot = np.sort(fitted[1].table.column("class").to_numpy()) if fitted else np.zeros(0, np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.zeros(batch.num_rows, np.int64)
            if router is not None and batch.num_rows:
                part = router.logits(matrix(batch.column("vector"))).argmax(axis=1)
                part[np.isin(batch.column("class").to_numpy(), pilot, assume_unique=True)] = IN_PILOT
            yield batch.append_column("part", pa.array(part.astype(np.int32)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, schema + ", part int")


def nearest(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` best of each row, and of what is as good up to rounding."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        return np.nonzero(scores >= (least - 1e-9 * np.maximum(1e-300, np.abs(scores).max(axis=1)))[:, None])
    return np.nonzero(np.ones(scores.shape, bool))


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in one order wherever the rows stand."""
    return (np.ascontiguousarray(a) * b).sum(axis=1)


def visits_needed(index: DataFrame, queries: DataFrame, router: Router, k: int) -> int:
    """Least number of parts that finds ``RECALL`` of the ``k`` nearest of ``MEASURED`` queries, which are compared
    with every vector; each task passes on its ``k`` nearest of each."""
    asked = queries.select("class", "vector").orderBy(F.xxhash64("class", F.lit(1)), "class").limit(MEASURED).toArrow()
    if not asked.num_rows:
        return 1
    x = matrix(asked.column("vector"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = x @ matrix(batch.column("vector")).T
                q, c = nearest(scores, k)
                yield pa.record_batch(
                    [pa.array(q), pa.array(scores[q, c]), batch.column("class").take(pa.array(c)), batch.column("part").take(pa.array(c))],
                    ["q", "score", "class", "part"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "class")
    found = index.select("class", "vector", "part").mapInArrow(scan, "q long, score double, class long, part int")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("q", "part").toArrow()
    rank = np.argsort(np.argsort(-router.logits(x), axis=1, kind="stable"), axis=1, kind="stable")
    part = best.column("part").to_numpy()
    needed = np.sort(np.where(part == IN_PILOT, 0, rank[best.column("q").to_numpy(), part])) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)])


def _blocks(many: Column | int, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil((F.lit(many) if isinstance(many, int) else many) / size)).cast("int")


def search(index: DataFrame, queries: DataFrame, fitted: tuple[Router, Pilot] | None, visits: int, k: int, many_queries: int) -> DataFrame:
    """(query, class, ids, score): the ``k`` nearest of each query in the pilot and the parts it visits."""
    found = "query long, class long, ids array<long>, score double"
    router, pilot = fitted or (None, None)
    held = index.where(F.col("part") != IN_PILOT)
    sizes = {r["part"]: r["many"] for r in held.groupBy("part").agg(F.count("*").alias("many")).collect()}  # at most MOST_PARTS
    if not sizes:
        return index.sparkSession.createDataFrame([], found)
    blocks = F.create_map(*[F.lit(x) for part, many in sizes.items() for x in (part, -(-many // BLOCK))])
    q_blocks = max(1, -(-many_queries * visits // (max(1, len(sizes)) * QUERY_BLOCK)))

    def visited(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            chosen, floor = np.zeros((batch.num_rows, 1), np.int64), np.full(batch.num_rows, -np.inf)
            if router is not None:
                x = matrix(batch.column("vector"))
                chosen = np.argsort(-router.logits(x), axis=1, kind="stable")[:, :visits]
                floor = pilot.floors(x, k)
            row = np.repeat(np.arange(batch.num_rows), chosen.shape[1])
            yield pa.record_batch(
                [batch.column("class").take(pa.array(row)), batch.column("vector").take(pa.array(row)), pa.array(chosen.ravel().astype(np.int32)),
                 pa.array(floor[row])], ["query", "x", "part", "floor"])

    def in_pilot(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, c, score = pilot.best(matrix(batch.column("vector")), k)
                yield pa.record_batch(
                    [batch.column("class").take(pa.array(row)), *(pilot.table.column(x).combine_chunks().take(pa.array(c)) for x in ("class", "ids")),
                     pa.array(score)], ["query", "class", "ids", "score"])

    kind = index.schema["vector"].dataType.simpleString()
    asked = queries.select("class", "vector").mapInArrow(visited, f"query long, x {kind}, part int, floor double").where(F.col("part").isin(list(sizes)))
    asked = asked.withColumn("q_block", F.pmod(F.xxhash64("query"), F.lit(q_blocks)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.element_at(blocks, F.col("part")) - 1)))
    held = held.withColumn("block", F.pmod(F.xxhash64("class"), F.element_at(blocks, F.col("part"))).cast("int")).withColumn(
        "q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            q = c = np.zeros(0, np.int64)
            score = np.zeros(0)
        else:
            x, y = matrix(a.column("x")), matrix(b.column("vector"))
            scores = x @ y.T
            q, c = nearest(scores, k)
            enough = scores[q, c] >= a.column("floor").to_numpy()[q]
            q, c = q[enough], c[enough]
            score = exact_scores(x[q], y[c])
        q, c = pa.array(q), pa.array(c)
        return pa.table({"query": a.column("query").take(q), "class": b.column("class").take(c), "ids": b.column("ids").take(c), "score": score})

    cell = ["part", "block", "q_block"]
    near = asked.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(compare, found)
    if pilot is not None:
        near = near.unionByName(queries.select("class", "vector").mapInArrow(in_pilot, found))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def nearest_neighbours(table: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows where ``is_query`` holds (a condition on ``key``), the ``k``
    rows found of the largest inner product, the row itself left out; ties to the smaller id."""
    table = table.select(F.col(f"`{key}`").alias(key), F.col(f"`{vector}`").alias(vector))
    asking = table.where(is_query).select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("vector")).where("query_id is not null")
    classes = written(vector_classes(table, k + 1, vector, key), "vector-classes")
    many = classes.count()
    fitted = fit_router(classes, many)
    index = written(placed(classes, fitted), "vector-parts")
    queries = written(index.join(asking.select("vector").distinct(), "vector", "left_semi"), "vector-queries")
    visits = 1 if fitted is None else visits_needed(index, queries, fitted[0], k)
    found = search(index, queries, fitted, visits, k + 1, queries.count())
    each = found.select("query", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    entry = F.struct((-F.col("score")).alias("minus"), "id", "score")
    lists = best.groupBy("query").agg(F.sort_array(F.collect_list(entry)).alias("best"))
    # equal queries share one list; it is sent to several tasks, for many of them may be equal
    spread = queries.select(F.col("class").alias("query"), "vector").join(lists, "query").select(
        "vector", "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = asking.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int"))
    answers = salted.join(spread, ["vector", "salt"]).select(
        "query_id", F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k).alias("best"))
    return answers.select("query_id", F.posexplode("best").alias("pos", "x")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("vec_id"), "x.score")
