"""Two-dimensional map of the profiles with queries placed among them."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as fixed
from ..session import written
from .clustering import added
from .neighbours import cosine_search, similar_entities

NEIGHBOURS = 8
VECTORS = 3  # iterated together; two are kept
STEPS, ROUNDS = 5, 6
SETTLED = 1e-3  # relative change of the eigenvalues at which the rounds end


def neighbour_graph(profiles: DataFrame, k: int = NEIGHBOURS, entity: str = "Town") -> DataFrame:
    """(a, b, w), both ways: each profile and its ``k`` most similar ones, weighted by the similarity."""
    near = similar_entities(profiles, k, entity).where("similarity > 0")
    one_way = near.select(F.col("entity_a").alias("a"), F.col("entity_b").alias("b"), F.col("similarity").alias("w"))
    other = one_way.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")
    return one_way.unionByName(other).groupBy("a", "b").agg(F.max("w").alias("w"))


def _names(step: int) -> list[str]:
    return [f"y{step}_{k}" for k in range(VECTORS)]


def _step(state: DataFrame, walk: DataFrame, step: int) -> DataFrame:
    """Adds the vectors after one step more. The state is read once: what a node has already, comes back to it along
    its own loop."""
    sent = state.withColumnRenamed("node", "b")
    kept = [F.sum(F.when(F.col("loop"), F.col(c))).alias(c) for c in state.columns if c != "node"]
    made = [F.sum(F.col("w") * F.col(y)).alias(name) for y, name in zip(_names(step - 1), _names(step), strict=True)]
    return walk.join(sent, "b").groupBy(F.col("a").alias("node")).agg(*kept, *made)


def _products(state: DataFrame, names: list[str]) -> np.ndarray:
    """Sums of the products of 1 and the vectors, weighted by ``d``; one row of numbers comes back."""

    def make(batches: Iterable[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = np.zeros((len(names) + 1, len(names) + 1))
        for batch in batches:
            d, *ys = (c.to_numpy() for c in batch.columns)
            rows = np.column_stack([np.ones(len(d)), *ys])
            total += rows.T @ (rows * d[:, None])
        return {0: total}

    return added(state.select("d", *names), make)[0].reshape(len(names) + 1, -1)


def _combined(state: DataFrame, names: list[str], turn: np.ndarray, mean: np.ndarray, keep: list[str]) -> DataFrame:
    columns = [F.col(c) - float(m) for c, m in zip(names, mean, strict=True)]
    made = [sum((c * float(t) for c, t in zip(columns, turn[:, j], strict=True)), F.lit(0.0)).alias(name) for j, name in enumerate(keep)]
    return state.select("node", "d", *made)


def neighbour_layout(edges: DataFrame) -> DataFrame:
    """(node, x, y): the two slowest ways in which a walk on the graph mixes, after the constant one.

    Leading eigenvectors by power iteration of a small block of vectors: a step is a join along the edges and a sum for
    each node. After some steps the best combinations of all vectors passed are taken, without the constant, from sums of
    products. Starting values are hashes of the nodes. Each axis has mean 0 and variance 1, weighted by degree,
    and its largest value positive. Nodes of an unconnected part stand at one place of an axis.
    """
    degrees = edges.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("d"))
    start = [(F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1 << 20)) / (1 << 20) - 0.5).alias(name) for k, name in enumerate(_names(0))]
    steps = edges.join(degrees.withColumnRenamed("node", "a"), "a").select("a", "b", (0.5 * F.col("w") / F.col("d")).alias("w"), F.lit(False).alias("loop"))
    loops = degrees.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.5).alias("w"), F.lit(True).alias("loop"))
    walk = written(steps.unionByName(loops), "map-walk")  # half stays, half goes to the neighbours
    state = written(degrees.select("node", "d", *start), "map-state")
    if state.isEmpty():
        return state.select("node", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    names = [name for step in range(STEPS + 1) for name in _names(step)]
    basis, before = names[:-VECTORS], None
    for turn_number in range(ROUNDS):
        for step in range(1, STEPS + 1):
            state = _step(state, walk, step)
        state = written(state, "map-state")
        products = _products(state, names)
        mean = products[0, 1:] / products[0, 0]
        centred = products[1:, 1:] - np.outer(mean, mean) * products[0, 0]
        n = len(basis)
        values, axes = np.linalg.eigh(centred[:n, :n])
        real = values > 1e-11 * max(values.max(), 1e-300)
        axes = axes[:, real] / np.sqrt(values[real])
        moved = axes.T @ centred[:n, VECTORS:] @ axes  # a step takes each vector to the one VECTORS places on
        speed, turn = np.linalg.eigh((moved + moved.T) / 2)
        turn = axes @ turn[:, np.argsort(-speed)]
        turn = np.pad(turn, ((0, 0), (0, max(0, VECTORS - turn.shape[1]))))
        speed = np.append(np.sort(speed)[::-1], (0.0, 0.0))[:2]
        if turn_number == ROUNDS - 1 or before is not None and np.abs(speed - before).max() <= SETTLED * max(speed[0], 1e-300):
            break
        before = speed
        state = _combined(state, basis, turn[:, :VECTORS], mean[:n], _names(0))
    flat = written(_combined(state, basis, turn[:, :2], mean[:n], ["x", "y"]), "map-axes")
    total, *ends = flat.agg(F.sum("d"), F.max("x"), F.min("x"), F.max("y"), F.min("y")).first()
    signs = [1.0 if high >= -low else -1.0 for high, low in (ends[:2], ends[2:])]
    scale = float(np.sqrt(total))
    return flat.select("node", *[(F.col(c) * (s * scale)).alias(c) for c, s in zip(("x", "y"), signs, strict=True)])


def entity_map_2d(
    profiles: DataFrame,
    queries: DataFrame,
    clusters: DataFrame,
    recommended: DataFrame,
    entity: str = "Town",
    query_id: str = "query_id",
    vector: str = "embedding",
    k: int = NEIGHBOURS,
    mark_top: int = fixed.MARK_TOP,
    mark_other: int = fixed.MARK_OTHER,
    mark_query: int = fixed.MARK_QUERY,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities laid out by the graph of their nearest profiles; a query stands at the mean of its ``k`` most similar
    entities, weighted by similarity.

    Three frames: the entities (coordinates, cluster, base mark), the queries (coordinates, mark), and the
    marks of recommended entities per query (mark, highlight by rank). The map of one query is all entities,
    that query, and its marks. Entities without a similar one, and queries like none, stand at 0, 0.
    """
    placed = written(neighbour_layout(neighbour_graph(profiles, k, entity)).withColumnRenamed("node", entity), "map")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("x", "y")]
    towns = profiles.select(entity).join(placed.select(entity, "x", "y"), entity, "left").select(entity, *zero)
    near = cosine_search(queries, profiles, k, query_id, vector, entity, "profile").where("similarity > 0")
    sums = [(F.sum(F.col(c) * F.col("similarity")) / F.sum("similarity")).alias(c) for c in ("x", "y")]
    users = near.join(towns, entity).groupBy(query_id).agg(*sums)
    users = queries.select(query_id).join(users, query_id, "left").select(query_id, *zero)
    marks = recommended.select(
        query_id,
        F.col("pueblo").alias(entity),
        F.lit(mark_top).alias("mark"),
        (fixed.HIGHLIGHT_FIRST - (F.col("rank") - 1) * fixed.HIGHLIGHT_STEP).cast("int").alias("highlight"),
    )
    return (
        towns.join(clusters, entity, "left").withColumn("mark", F.lit(mark_other)),
        users.withColumn("mark", F.lit(mark_query)),
        marks,
    )
