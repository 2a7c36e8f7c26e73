"""Statistics, metadata and rankings of the reviewed places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_half_even
from ..session import written
from . import counts as C


def entity_stats(cells: DataFrame, decimals: int | None = 2, entity: str = "Town") -> DataFrame:
    """Region, size, polarity statistics and types per entity, from ``review_cells``.

    Rounded to two decimals by default because the rankings below order by the rounded
    values; ``decimals=None`` keeps full precision.
    """
    stats = cells.groupBy(entity).agg(
        F.min_by("Region", "first_row").alias("Region"),
        F.sum("n").alias("n_reviews"),
        C.mean("Polarity").alias("mean_polarity"),
        C.quantile("Polarity", 0.5).alias("median_polarity"),
        C.stddev("Polarity").alias("std_polarity"),
        C.percent_where(F.col("Polarity") == 5).alias("pct_5"),
        C.percent_where(F.col("Polarity") <= 2).alias("pct_1_2"),
        F.array_join(F.array_sort(F.collect_set("Type")), ", ").alias("types"),
    )
    if decimals is None:
        return stats
    measures = ["mean_polarity", "median_polarity", "std_polarity", "pct_5", "pct_1_2"]
    return stats.withColumns({m: round_half_even(m, decimals) for m in measures})


def entity_meta(cells: DataFrame, entity: str = "Town") -> DataFrame:
    """The recommender's metadata per entity, unrounded."""
    return cells.groupBy(entity).agg(
        F.min_by("Region", "first_row").alias("Region"),
        F.sum("n").alias("n_reviews"),
        C.mean("Polarity").alias("avg_polarity"),
        C.percent_where(F.col("Polarity") == 5).alias("pct_5"),
        C.percent_where(F.col("Polarity") <= 2).alias("pct_neg"),
        F.array_join(F.array_sort(F.collect_set("Type")), " / ").alias("tipos"),
    )


def top_by_volume(stats: DataFrame, k: int = 20, entity: str = "Town") -> DataFrame:
    return stats.orderBy(F.desc("n_reviews"), entity).limit(k)


def top_by_mean(stats: DataFrame, k: int = 20, min_n: int = 10, entity: str = "Town") -> DataFrame:
    enough = stats.where(F.col("n_reviews") >= min_n)
    return enough.orderBy(F.desc("mean_polarity"), entity).limit(k)


def bottom_by_mean(
    stats: DataFrame, k: int = 15, min_n: int = 10, entity: str = "Town"
) -> DataFrame:
    enough = stats.where(F.col("n_reviews") >= min_n)
    return enough.orderBy("mean_polarity", entity).limit(k)


def volume_vs_quality(stats: DataFrame, min_n: int = 5, entity: str = "Town") -> DataFrame:
    """Size and mean per entity with the size of its plot mark."""
    return stats.where(F.col("n_reviews") >= min_n).select(
        entity,
        "n_reviews",
        "mean_polarity",
        (F.coalesce("std_polarity", F.lit(0.5)) * 200 + 20).alias("mark_size"),
    )


def entity_index(df: DataFrame, entity: str = "Town") -> DataFrame:
    """Sorted distinct entities with their position from 0.

    Ranges are sorted in their own tasks and written once; a range starts at the number of
    entities in the ranges before it. Rankings do not use this: ordering by the entity
    itself is the same order.
    """
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = written(
        df.select(entity).distinct().repartitionByRange(entity).sortWithinPartitions(entity)
        .select(entity, F.spark_partition_id().alias("_range"), position.alias("_at")),
        "entity-index",
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )  # one row a range
    return ranged.join(starts, "_range").select(entity, (F.col("_start") + F.col("_at")).alias("entity_idx"))


def rank_entities_by_count(cells: DataFrame, k: int, entity: str = "Town") -> DataFrame:
    """The ``k`` most reviewed entities; equal counts in name order."""
    sizes = cells.groupBy(entity).agg(F.sum("n").alias("n_reviews"))
    return sizes.orderBy(F.desc("n_reviews"), entity).limit(k)
