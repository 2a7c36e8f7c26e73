"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..session import scratch  # noqa: F401 - the query modules take it from here


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double so that the order of summation cannot show in a comparison."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
            if isinstance(f.dataType, DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def long_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """One row per vector element, for results that are vectors."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "value"))
