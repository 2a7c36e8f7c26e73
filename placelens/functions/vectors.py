"""Dense vectors held as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import column


def dot(left: Column | str, right: Column | str) -> Column:
    products = F.zip_with(
        column(left), column(right), lambda a, b: a.cast("double") * b.cast("double")
    )
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(value: Column | str) -> Column:
    return F.sqrt(
        F.aggregate(
            column(value),
            F.lit(0.0),
            lambda acc, x: acc + x.cast("double") * x.cast("double"),
        )
    )


def l2_normalize(value: Column | str) -> Column:
    """Unit vector as array<double>; a zero vector stays zero.

    The length is repeated into an array beside the vector so that it is computed
    once per row. Inside the lambda it would be computed once per element.
    """
    value = column(value)
    length = F.array_repeat(norm(value), F.size(value))
    return F.zip_with(
        value, length, lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))
    )


def concat_vectors(left: Column | str, right: Column | str) -> Column:
    return F.concat(column(left).cast("array<double>"), column(right).cast("array<double>"))
