"""Distributions, crosstabs, box plots and histograms of the whole review table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric
from . import counts as C

POLARITIES = [1, 2, 3, 4, 5]


def dataset_summary(cells: DataFrame) -> DataFrame:
    """One row over ``review_cells``: sizes, types in sorted order, polarity statistics."""
    return cells.agg(
        F.sum("n").alias("n_reviews"),
        F.countDistinct("Town").alias("n_towns"),
        F.countDistinct("Region").alias("n_regions"),
        F.array_join(F.array_sort(F.collect_set("Type")), ", ").alias("types"),
        F.min("Polarity").alias("min_polarity"),
        F.max("Polarity").alias("max_polarity"),
        C.mean("Polarity").alias("mean_polarity"),
        C.quantile("Polarity", 0.5).alias("median_polarity"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column: one row per column, one scan."""
    names = df.columns
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in names])
    return wide.unpivot([], names, "column_name", "nulls")


def _share_of_total(groups: DataFrame) -> DataFrame:
    whole = groups.agg(F.sum("n")).scalar()
    return groups.withColumn("pct", F.col("n") / whole * 100)


def polarity_distribution(cells: DataFrame) -> DataFrame:
    groups = cells.groupBy("Polarity").agg(F.sum("n").alias("n"))
    return _share_of_total(groups).orderBy("Polarity")


def type_share(cells: DataFrame) -> DataFrame:
    groups = cells.groupBy("Type").agg(F.sum("n").alias("n"))
    return _share_of_total(groups).orderBy(F.desc("n"), "Type")


def polarity_by_type(cells: DataFrame) -> DataFrame:
    """Counts ``n_1..n_5`` and row shares ``pct_1..pct_5`` per type."""
    table = cells.groupBy("Type").pivot("Polarity", POLARITIES).agg(F.sum("n")).na.fill(0)
    row_total = sum((F.col(f"`{p}`") for p in POLARITIES), F.lit(0))
    return table.select(
        "Type",
        *[F.col(f"`{p}`").alias(f"n_{p}") for p in POLARITIES],
        *[(F.col(f"`{p}`") / row_total * 100).alias(f"pct_{p}") for p in POLARITIES],
    )


def region_by_type(cells: DataFrame) -> DataFrame:
    """(Region, Type, n, total): every type that occurs, with its region's total, smallest
    total first."""
    counts = cells.groupBy("Region", "Type").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("Region"))  # one row a type
    return counts.withColumn("total", total).orderBy("total", "Region", "Type")


def describe_by_type(cells: DataFrame) -> DataFrame:
    return cells.groupBy("Type").agg(
        F.sum("n").alias("n"),
        C.mean("Polarity").alias("mean_polarity"),
        C.quantile("Polarity", 0.5).alias("median_polarity"),
        C.stddev("Polarity").alias("std_polarity"),
    )


def boxplot_stats(
    df: DataFrame, value: str, by: str, low: int | None = None, high: int | None = None
) -> DataFrame:
    """Quartiles, whiskers (extreme data within 1.5 interquartile ranges of the box) and
    outlier count per group, largest group first."""
    column = F.col(value) if low is None else numeric.clip(value, low, high)
    return boxplot_of_counts(C.count_groups(df, F.col(by), column.alias("value")), by).orderBy(F.desc("size"), by)


def boxplot_of_counts(counts: DataFrame, by: str, value: str = "value") -> DataFrame:
    """The same from counted values: ``by``, ``value`` and multiplicity ``n``."""
    table = counts.groupBy(by, F.col(value).alias("value")).agg(F.sum("n").alias("n"))
    quartile = table.groupBy(by).agg(
        F.sum("n").alias("size"), C.quantile("value", [0.25, 0.5, 0.75]).alias("q")
    )
    box = quartile.select(
        by, "size", *[F.col("q")[i].alias(name) for i, name in enumerate(["q1", "median", "q3"])]
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    above = F.col("value") <= F.col("q3") + reach
    below = F.col("value") >= F.col("q1") - reach
    return (
        table.join(box, by)
        .groupBy(by, "size", "q1", "median", "q3")
        .agg(
            # a whisker never starts inside the box
            F.least(F.min(F.when(below, F.col("value"))), F.col("q1")).alias("whisker_low"),
            F.greatest(F.max(F.when(above, F.col("value"))), F.col("q3")).alias("whisker_high"),
            F.sum(F.when(above & below, 0).otherwise(F.col("n"))).alias("outliers"),
        )
    )


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 60) -> DataFrame:
    """Equal-width bins over the range of the clipped values; the last bin is closed.

    The reviews are scanned once, down to one row per distinct clipped value.
    """
    table = C.count_groups(df, numeric.clip(value, low, high).alias("value"))
    limits = table.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).select(
        # an empty range is widened by one half on both sides
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    edges = limits.select(F.struct("lo", "hi"))
    lo, hi = edges.scalar()["lo"], edges.scalar()["hi"]
    placed = (
        table.withColumn(
            "bin", F.least(F.floor((F.col("value") - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("int")
        )
        .groupBy("bin")
        .agg(F.sum("n").alias("n"))
    )
    grid = limits.select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
        (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_start"),
    )
    return (
        grid.join(placed, "bin", "left")
        .select("bin", "bin_start", F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy("bin")
    )


def mean_median_markers(df: DataFrame) -> DataFrame:
    """Median and mean of n_words, median of n_chars."""
    long = _value_counts(df, ["n_words", "n_chars"])
    stats = long.groupBy("metric").agg(
        C.quantile("value", 0.5).alias("median"), C.mean("value").alias("mean")
    )
    def pick(metric: str, statistic: str):
        return F.max(F.when(F.col("metric") == metric, F.col(statistic)))

    return stats.agg(
        pick("n_words", "median").alias("median_words"),
        pick("n_words", "mean").alias("mean_words"),
        pick("n_chars", "median").alias("median_chars"),
    )


def mean_words_by_polarity(df: DataFrame) -> DataFrame:
    return df.groupBy("Polarity").agg(F.avg("n_words").alias("mean_words")).orderBy("Polarity")


def _value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per (metric, value) of several integer columns in one scan."""
    long = df.select(*[F.col(c).cast("long") for c in columns]).unpivot(
        [], columns, "metric", "value"
    )
    return C.count_groups(long.where(F.col("value").isNotNull()), "metric", "value")


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles and max per column, in long form."""
    columns = columns or ["n_chars", "n_words", "n_sents"]
    stats = _value_counts(df, columns).groupBy("metric").agg(
        F.sum("n").alias("count"),
        C.mean("value").alias("mean"),
        C.stddev("value").alias("std"),
        F.min("value").alias("min"),
        C.quantile("value", [0.25, 0.5, 0.75]).alias("q"),
        F.max("value").alias("max"),
    )
    return stats.select(
        "metric", "count", "mean", "std", "min",
        *[F.col("q")[i].alias(name) for i, name in enumerate(["p25", "p50", "p75"])],
        "max",
    )


def words_vs_polarity_points(df: DataFrame, high: int = 600) -> DataFrame:
    return df.select("row_id", "Polarity", numeric.clip("n_words", 0, high).alias("n_words"))
