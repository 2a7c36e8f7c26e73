"""Small numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CLUSTER_PALETTE, POLARITY_WEIGHTS
from .text import column

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def coerce_polarity(value: Column | str) -> Column:
    """Number in a string truncated towards zero to an int; anything else is null.

    The pattern keeps out what a cast would accept and a number parser would not
    (``5d``, ``inf``); ``try_cast`` turns an overflow into null.
    """
    text = F.trim(column(value).cast("string"), F.lit(" \t\n\r\f\v"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double").try_cast("int"))


def clip(value: Column | str, low: float, high: float) -> Column:
    """Clamp to [low, high]; null stays null (``least``/``greatest`` would skip it)."""
    value = column(value)
    return F.when(
        value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high))
    )


def round_half_even(value: Column | str, decimals: int) -> Column:
    """Scale, round to the even neighbour, scale back: the array-library definition."""
    scale = float(10**decimals)
    return F.rint(column(value) * scale) / scale


def polarity_weight(value: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, POLARITY_WEIGHTS)), column(value).cast("int"))


def cluster_colour(value: Column | str) -> Column:
    palette = F.array(*map(F.lit, CLUSTER_PALETTE))
    return F.element_at(palette, (column(value) % len(CLUSTER_PALETTE) + 1).cast("int"))
