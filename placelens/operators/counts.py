"""Counted groups: the small frame that every statistic is computed from.

Reviews are reduced once, map-side, to counts per distinct key combination. The
buffers are longs, so Spark uses hash aggregation inside generated code, and a hot key
costs each task one row. Medians, quartiles and first values are then exact results
over the counts instead of sort- or object-based aggregates over the reviews.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["Town", "Region", "Type", "Polarity"]


def count_groups(df: DataFrame, *keys: str | Column, order: str | None = None) -> DataFrame:
    """``keys, n`` and, given an order column, ``first_row`` = the smallest order value."""
    measures = [F.count(F.lit(1)).alias("n")]
    if order is not None:
        measures.append(F.min(order).alias("first_row"))
    return df.groupBy(*keys).agg(*measures)


def review_cells(reviews: DataFrame, order: str = "row_id") -> DataFrame:
    """Counts per (Town, Region, Type, Polarity): the input of all distribution operators."""
    return count_groups(reviews, *CELL, order=order)


def total(n: str = "n") -> Column:
    return F.sum(n)


def _exact(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def mean(value: str, n: str = "n") -> Column:
    """Mean of an integer value with multiplicity ``n``."""
    weighted = F.sum(_exact(F.col(value)) * F.col(n))
    return weighted.cast("double") / F.sum(n).cast("double")


def stddev(value: str, n: str = "n") -> Column:
    """Sample standard deviation of an integer value with multiplicity; null for one row.

    The moments are exact decimals, so nothing cancels and any order of summation
    gives the same result.
    """
    v, w = _exact(F.col(value)), F.col(n).cast("decimal(19,0)")
    rows, s1, s2 = _exact(F.sum(w)), _exact(F.sum(v * w)), _exact(F.sum(v * v * w))
    spread = _exact(rows * s2) - _exact(s1 * s1)
    size = F.sum(n).cast("double")
    return F.when(size > 1, F.sqrt(spread.cast("double") / (size * (size - 1))))


def quantile(value: str, share: float | list[float], n: str = "n") -> Column:
    """Exact interpolated quantile(s) of a value with multiplicity ``n``."""
    shares = F.array(*map(F.lit, share)) if isinstance(share, list) else F.lit(share)
    return F.percentile(F.col(value), shares, F.col(n))


def percent_where(condition: Column, n: str = "n") -> Column:
    hits = F.sum(F.when(condition, F.col(n)).otherwise(0))
    return hits.cast("double") / F.sum(n).cast("double") * 100
