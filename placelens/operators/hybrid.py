"""Hybrid score: content similarity mixed with a vote of neighbouring reviews."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric, vectors
from ..functions.constants import (
    ALPHA_HIGH,
    ALPHA_LOW,
    DIVERSITY_SHARE,
    SIZE_SHARE,
    WIDEST_STD,
)
from . import blocks
from . import counts as C
from .neighbours import knn

KNN_K = 20


def dynamic_alpha(cells: DataFrame, entity: str = "Town") -> DataFrame:
    """Weight of the content score per entity: high for few or uniform reviews.

    The largest size is a scalar over the counted groups, not recomputed per entity.
    """
    sizes = cells.groupBy(entity).agg(F.sum("n").alias("n"), C.stddev("Polarity").alias("std"))
    largest = cells.groupBy(entity).agg(F.sum("n").alias("n")).agg(F.max("n")).scalar()
    diversity = F.least(F.coalesce("std", F.lit(0.0)) / WIDEST_STD, F.lit(1.0))
    confidence = F.col("n") / largest * SIZE_SHARE + diversity * DIVERSITY_SHARE
    return sizes.select(entity, numeric.clip(1.0 - confidence, ALPHA_LOW, ALPHA_HIGH).alias("alpha"))


def alpha_extremes(alphas: DataFrame, k: int = 3, entity: str = "Town") -> DataFrame:
    """The ``k`` lowest and ``k`` highest weights."""
    low = alphas.orderBy("alpha", entity).limit(k)
    high = alphas.orderBy(F.desc("alpha"), F.desc(entity)).limit(k)
    return low.withColumn("side", F.lit("low")).unionByName(
        high.withColumn("side", F.lit("high"))
    )


def neighbour_vote(
    neighbours: DataFrame,
    drop_first: bool = True,
    query_id: str = "query_id",
    entity: str = "Town",
) -> DataFrame:
    """Polarity-weighted votes per (query, entity), scaled so that the best entity of a
    query has 1. The nearest neighbour is dropped by default, even for a query that is
    not in the corpus."""
    voters = neighbours.where(F.col("rank") > 1) if drop_first else neighbours
    vote = F.col("similarity") * numeric.polarity_weight("Polarity")
    votes = voters.groupBy(query_id, entity).agg(F.sum(vote).alias("votes"))
    # Entities without a vote count as zero, so a negative maximum leaves votes unscaled.
    best = F.max("votes").over(Window.partitionBy(query_id))
    return votes.select(
        query_id,
        entity,
        F.when(best > 0, F.col("votes") / best).otherwise(F.col("votes")).alias("cf"),
    )


def _attach_votes(queries: DataFrame, votes: DataFrame, query_id: str, entity: str) -> DataFrame:
    """Queries with their few votes as two parallel arrays (at most k entries)."""
    packed = votes.groupBy(query_id).agg(F.collect_list(F.struct(entity, "cf")).alias("_votes"))
    none = F.array().cast("array<string>"), F.array().cast("array<double>")
    return queries.join(packed, query_id, "left").select(
        *queries.columns,
        F.coalesce(F.col("_votes")[entity], none[0]).alias("_voted"),
        F.coalesce(F.col("_votes")["cf"], none[1]).alias("_cf"),
    )


def _score_block(a: pa.Table, b: pa.Table, vector: str, entity: str) -> tuple[np.ndarray, ...]:
    """Content, vote and hybrid score matrices of one grid cell."""
    cb = blocks.cosine(a, b, vector, "profile")
    cf = np.zeros_like(cb)
    row = np.repeat(np.arange(a.num_rows), pc.list_value_length(a.column("_voted")).to_numpy())
    names = b.column(entity).combine_chunks()
    where = pc.index_in(pc.list_flatten(a.column("_voted")), value_set=names)
    where = pc.fill_null(where, -1).to_numpy()
    found = where >= 0
    cf[row[found], where[found]] = pc.list_flatten(a.column("_cf")).to_numpy()[found]
    alpha = b.column("alpha").to_numpy()
    hybrid = np.round(alpha * cb + (1 - alpha) * cf, blocks.SCORE_DECIMALS) + 0.0
    return cb, cf, hybrid


def _sides(
    queries: DataFrame,
    votes: DataFrame,
    profiles: DataFrame,
    alphas: DataFrame,
    query_id: str,
    entity: str,
) -> tuple[DataFrame, DataFrame]:
    left = _attach_votes(queries, votes, query_id, entity)
    # an entity without a weight has no reviews to vote with: its content decides
    right = profiles.join(alphas, entity, "left").select(
        entity, "profile", F.coalesce("alpha", F.lit(ALPHA_HIGH)).alias("alpha")
    )
    return left, right


def score_hybrid(
    queries: DataFrame,
    votes: DataFrame,
    profiles: DataFrame,
    alphas: DataFrame,
    top_n: int,
    query_id: str = "query_id",
    vector: str = "embedding",
    entity: str = "Town",
    **sizes: int,
) -> DataFrame:
    """``alpha * cb + (1 - alpha) * cf`` per (query, entity).

    A grid cell returns only the best ``top_n`` per query, equal scores to the later entity.
    """
    left, right = _sides(
        queries.select(query_id, vector), votes, profiles, alphas, query_id, entity
    )
    id_type = left.schema[query_id].dataType.simpleString()
    schema = (
        f"`{query_id}` {id_type}, `{entity}` string, alpha double, "
        "cb double, cf double, score double"
    )

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        b = blocks.sort_by(b, entity, "descending")
        cb, cf, hybrid = _score_block(a, b, vector, entity)
        mask = blocks.best_k(hybrid, top_n)
        return blocks.emit(
            a.select([query_id]),
            b.select([entity, "alpha"]),
            mask,
            {"cb": cb, "cf": cf, "score": hybrid},
        )

    return blocks.block_join(left, right, query_id, entity, kernel, schema, **sizes)


def rank_recommendations(
    scored: DataFrame, top_n: int = 5, query_id: str = "query_id", entity: str = "Town"
) -> DataFrame:
    if top_n < 1:
        raise ValueError("top_n must be at least 1")
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), F.desc(entity))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def recommend(
    queries: DataFrame,
    corpus: DataFrame,
    profiles: DataFrame,
    alphas: DataFrame,
    meta: DataFrame,
    clusters: DataFrame | None = None,
    topics: DataFrame | None = None,
    top_n: int = 5,
    k: int = KNN_K,
    drop_first: bool = True,
    query_id: str = "query_id",
    vector: str = "embedding",
    entity: str = "Town",
    decimals: bool = True,
) -> DataFrame:
    """Best entities for a whole table of queries, with metadata, cluster and topics.

    ``clusters`` has (entity, cluster) and ``topics`` (entity, topicos). They join by
    name; both are one row per entity and Spark broadcasts them when they are small.
    """
    near = knn(queries, corpus, k + 1, query_id, vector, (entity, "Polarity"))
    votes = neighbour_vote(near, drop_first, query_id, entity)
    scored = score_hybrid(
        queries, votes, profiles, alphas, top_n, query_id, vector, entity
    )
    best = rank_recommendations(scored, top_n, query_id, entity).join(meta, entity, "left")
    if clusters is not None:
        best = best.join(clusters, entity, "left").withColumn(
            "color", numeric.cluster_colour("cluster")
        )
    if topics is not None:
        best = best.join(topics, entity, "left")

    def rounded(name: str, digits: int):
        return numeric.round_half_even(name, digits) if decimals else F.col(name)

    return best.select(
        query_id,
        "rank",
        F.col(entity).alias("pueblo"),
        F.col("Region").alias("region"),
        rounded("score", 4).alias("similitud"),
        rounded("avg_polarity", 2).alias("polarity"),
        "n_reviews",
        rounded("pct_neg", 1).alias("pct_neg"),
        "tipos",
        rounded("alpha", 3).alias("alpha"),
        *([] if clusters is None else ["cluster", "color"]),
        *([] if topics is None else ["topicos"]),
    )


def truth_ranks(
    queries: DataFrame,
    votes: DataFrame,
    profiles: DataFrame,
    alphas: DataFrame,
    truth: str = "truth",
    query_id: str = "query_id",
    vector: str = "embedding",
    entity: str = "Town",
    **sizes: int,
) -> DataFrame:
    """Rank of the true entity per (query, method), equal scores behind the later entity.

    The true entity's own scores come first, from a join on its name. Every grid cell then
    counts how many entities beat them, so no ranking of all entities is materialised. A
    true entity without a profile cannot be found: it ranks behind all that have one.
    """
    left, right = _sides(
        queries.select(query_id, truth, vector), votes, profiles, alphas, query_id, entity
    )
    own = right.select(
        F.col(entity).alias(truth),
        vectors.l2_normalize("profile").alias("_profile"),
        F.col("alpha").alias("_alpha"),
    )
    cast_vote = F.try_element_at(
        F.map_from_arrays("_voted", "_cf"), F.col(truth)
    )
    cb = F.when(
        F.col("_profile").isNotNull(),
        F.round(vectors.dot(vectors.l2_normalize(vector), "_profile"), blocks.SCORE_DECIMALS),
    )
    left = (
        left.join(own, truth, "left")
        .withColumn("_truth_cb", cb)
        .withColumn(
            "_truth_hybrid",
            F.round(
                F.col("_alpha") * F.col("_truth_cb")
                + (1 - F.col("_alpha")) * F.coalesce(cast_vote, F.lit(0.0)),
                blocks.SCORE_DECIMALS,
            ),
        )
        .drop("_profile", "_alpha")
    )
    id_type = left.schema[query_id].dataType.simpleString()
    schema = f"`{query_id}` {id_type}, hybrid long, content_based long"

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        b = blocks.sort_by(b, entity)
        cb, _, hybrid = _score_block(a, b, vector, entity)
        names = np.array(b.column(entity).to_pylist(), dtype=object)
        wanted = np.array(a.column(truth).to_pylist(), dtype=object)
        later = np.arange(len(names))[None, :] >= np.searchsorted(names, wanted, "right")[:, None]
        other = names[None, :] != wanted[:, None]

        def beaten_by(scores: np.ndarray, own_score: str) -> np.ndarray:
            mine = a.column(own_score).fill_null(-np.inf).to_numpy()[:, None]
            return (other & ((scores > mine) | ((scores == mine) & later))).sum(axis=1)

        return pa.table(
            {
                query_id: a.column(query_id),
                "hybrid": pa.array(beaten_by(hybrid, "_truth_hybrid"), pa.int64()),
                "content_based": pa.array(beaten_by(cb, "_truth_cb"), pa.int64()),
            }
        )

    counted = blocks.block_join(left, right, query_id, entity, kernel, schema, **sizes)
    ranks = counted.groupBy(query_id).agg(
        (F.sum("hybrid") + 1).alias("hybrid"), (F.sum("content_based") + 1).alias("content_based")
    )
    return ranks.unpivot([query_id], ["hybrid", "content_based"], "method", "rank")
