"""One mean vector per entity."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from .sampling import first_n_per_group, stratified_first


def mean_vector(df: DataFrame, entity: str = "Town", vector: str = "embedding") -> DataFrame:
    """Mean of the vectors per entity. Summaries merge map-side, one vector per group."""
    packed = df.select(entity, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    means = packed.groupBy(entity).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return means.select(entity, vector_to_array("_m").alias("profile"))


def entity_profile_first_n(
    df: DataFrame, n: int = 150, entity: str = "Town", vector: str = "embedding"
) -> DataFrame:
    """Mean of the first ``n`` vectors per entity, not normalised again."""
    rows = df.select(entity, "row_id", vector)
    return mean_vector(first_n_per_group(rows, [entity], ["row_id"], n), entity, vector)


def entity_profile_stratified(
    df: DataFrame,
    per_entity: int = 100,
    entity: str = "Town",
    polarity: str = "Polarity",
    vector: str = "embedding",
) -> DataFrame:
    """Unweighted mean of the first rows of each polarity. The polarity only decides which
    rows are taken; it does not weight them."""
    rows = df.select(entity, polarity, "row_id", vector)
    return mean_vector(stratified_first(rows, per_entity, entity, polarity), entity, vector)


def normalize_profiles(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("profile", vectors.l2_normalize("profile"))
