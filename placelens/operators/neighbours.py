"""Exact cosine search, nearest neighbours and similarity between entities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks


def _type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def cosine_search(
    queries: DataFrame,
    targets: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_vector: str = "embedding",
    target_id: str = "Town",
    target_vector: str = "profile",
    payload: tuple[str, ...] = (),
    tie_order: str = "ascending",
    **sizes: int,
) -> DataFrame:
    """The ``k`` most similar targets per query, ranked.

    Every grid cell returns at most ``k`` rows per query; the final ranking merges those.
    """
    left = queries.select(query_id, query_vector)
    right = targets.select(target_id, *payload, F.col(target_vector).alias("_target"))
    kept = [target_id, *payload]
    schema = ", ".join(
        [f"`{query_id}` {_type_of(left, query_id)}"]
        + [f"`{c}` {_type_of(right, c)}" for c in kept]
        + ["similarity double"]
    )

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        b = blocks.sort_by(b, target_id, tie_order)
        scores = blocks.cosine(a, b, query_vector, "_target")
        mask = blocks.best_k(scores, k)
        return blocks.emit(a.select([query_id]), b.select(kept), mask, {"similarity": scores})

    pairs = blocks.block_join(left, right, query_id, target_id, kernel, schema, **sizes)
    tie = F.asc(target_id) if tie_order == "ascending" else F.desc(target_id)
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("similarity"), tie))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 21,
    query_id: str = "query_id",
    vector: str = "embedding",
    payload: tuple[str, ...] = ("Town", "Polarity"),
    **sizes: int,
) -> DataFrame:
    """Exact nearest corpus rows per query; equal similarity goes to the earlier row. A
    corpus of fewer than ``k`` rows gives what there is."""
    return cosine_search(
        queries, corpus, k, query_id, vector, "row_id", vector, payload, **sizes
    )


def similar_entities(profiles: DataFrame, k: int, entity: str = "Town", **sizes: int) -> DataFrame:
    """The ``k`` most similar other entities of every entity, ranked. The full matrix grows
    with the square of the entities and is not offered."""
    left = profiles.select(F.col(entity).alias("entity_a"), F.col("profile").alias("_a"))
    right = profiles.select(F.col(entity).alias("entity_b"), "profile")
    near = cosine_search(left, right, k + 1, "entity_a", "_a", "entity_b", "profile", **sizes)
    order = Window.partitionBy("entity_a").orderBy(F.desc("similarity"), "entity_b")
    others = near.where("entity_a <> entity_b").withColumn("rank", F.row_number().over(order))
    return others.where(F.col("rank") <= k)


def most_similar_pairs(
    profiles: DataFrame, k: int = 10, entity: str = "Town", **sizes: int
) -> DataFrame:
    """The ``k`` most similar unordered pairs; every cell returns at most ``k`` of them."""
    left = profiles.select(F.col(entity).alias("entity_a"), F.col("profile").alias("_a"))
    right = profiles.select(F.col(entity).alias("entity_b"), F.col("profile").alias("_b"))

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = blocks.sort_by(a, "entity_a"), blocks.sort_by(b, "entity_b")
        scores = blocks.cosine(a, b, "_a", "_b")
        names_a = np.array(a.column("entity_a").to_pylist(), dtype=object)
        names_b = np.array(b.column("entity_b").to_pylist(), dtype=object)
        scores[names_a[:, None] >= names_b[None, :]] = -np.inf
        best = blocks.best_k(scores.reshape(1, -1), k).reshape(scores.shape)
        best &= np.isfinite(scores)
        return blocks.emit(
            a.select(["entity_a"]), b.select(["entity_b"]), best, {"similarity": scores}
        )

    schema = "entity_a string, entity_b string, similarity double"
    pairs = blocks.block_join(left, right, "entity_a", "entity_b", kernel, schema, **sizes)
    return pairs.orderBy(F.desc("similarity"), "entity_a", "entity_b").limit(k)
