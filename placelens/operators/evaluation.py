"""Ranking metrics over a frame of (method, query, rank of the true entity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit_rate(k: int, rank: str = "rank") -> Column:
    return F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0))


def mrr(rank: str = "rank") -> Column:
    return F.avg(1.0 / F.col(rank))


def ndcg(k: int, rank: str = "rank") -> Column:
    """One relevant item, so the ideal gain is 1."""
    return F.avg(F.when(F.col(rank) <= k, 1.0 / F.log2(F.col(rank) + 1)).otherwise(0.0))


def mean_rank(rank: str = "rank") -> Column:
    return F.avg(rank)


def evaluate(ranks: DataFrame) -> DataFrame:
    """The evaluation record: one row per method."""
    return ranks.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_eval"),
        *[hit_rate(k).alias(f"HR@{k}") for k in (1, 3, 5, 10)],
        mrr().alias("MRR"),
        ndcg(5).alias("NDCG@5"),
        mean_rank().alias("rank_mean"),
    )


def metric_gain(record: DataFrame) -> DataFrame:
    """Hybrid minus content-based, in percentage points."""

    def of(method: str, metric: str) -> Column:
        return F.max(F.when(F.col("method") == method, F.col(f"`{metric}`")))

    return record.agg(
        *[
            ((of("hybrid", m) - of("content_based", m)) * 100).alias(f"gain_{m}")
            for m in ("HR@5", "MRR", "NDCG@5")
        ]
    )
