"""Topics of sampled reviews, their terms and their shares per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..functions.numeric import round_half_even
from . import counts as C
from .density import OUTLIER, density_clusters


def assign_topics(
    sample: DataFrame, n_topics: int = 19, vector: str = "embedding", row_id: str = "row_id", neighbours: int | None = None
) -> DataFrame:
    """Topic per review: density clusters of the vectors, at most ``n_topics``, numbered from the largest; reviews
    in no dense group are outliers (-1). A topic has at least ``max(5, rows // (3 * n_topics))`` reviews, which
    is also the number of neighbours that density is measured by unless ``neighbours`` says otherwise."""
    minimum = max(5, sample.count() // (3 * n_topics))
    found = density_clusters(sample, minimum, n_topics, neighbours, row_id, vector)
    return sample.join(found.withColumnRenamed("cluster", "topic"), row_id)  # a row each; bounded by the sample


def topic_term_counts(documents: DataFrame, column: str = "text") -> DataFrame:
    """Counts of words of two or more letters, digits or underscores per topic."""
    found = F.regexp_extract_all(
        F.lower(column), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)
    )
    words = documents.select("topic", F.explode(found).alias("term"))
    return C.count_groups(words, "topic", "term")


def topic_terms(counts: DataFrame, k: int = 5) -> DataFrame:
    """Strongest terms per topic by class-based TF-IDF:
    ``tf(t, c) / |c| * ln(1 + A / f(t))`` with A the mean number of words per topic.

    Outliers are one more class for the frequencies but get no terms.
    """
    by_topic = counts.groupBy("topic").agg(F.sum("n").alias("words"))
    average = by_topic.agg(F.avg("words")).scalar()
    by_term = counts.groupBy("term").agg(F.sum("n").alias("f"))
    weight = F.col("n") / F.col("words") * F.log(1.0 + average / F.col("f"))
    weighted = (
        counts.where(F.col("topic") != OUTLIER)
        .join(by_term, "term")
        .join(by_topic, "topic")
        .select("topic", "term", F.round(weight, 12).alias("weight"))
    )
    order = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    ranked = weighted.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def topic_sizes(assigned: DataFrame) -> DataFrame:
    valid = assigned.where(F.col("topic") != OUTLIER)
    return C.count_groups(valid, "topic").orderBy("topic")


def topic_distribution(assigned: DataFrame, entity: str = "Town") -> DataFrame:
    """Share of every valid topic among an entity's reviews that have one; all zero for an
    entity with outliers only. Long form, zeros included.

    The list of topics is bounded by the number asked for and reaches every entity as a
    scalar array, so there is no join to fill the grid.
    """
    counts = C.count_groups(assigned, entity, "topic")
    valid = F.col("topic") != OUTLIER
    topics = counts.where(valid).agg(F.array_sort(F.collect_set("topic"))).scalar()
    packed = counts.groupBy(entity).agg(
        F.sum(F.when(valid, F.col("n")).otherwise(0)).alias("_total"),
        F.map_from_entries(F.collect_list(F.struct("topic", "n"))).alias("_n"),
    )
    share = F.coalesce(F.try_element_at("_n", F.col("topic")), F.lit(0)) / F.col("_total")
    return packed.select(entity, "_total", "_n", F.explode(topics).alias("topic")).select(
        entity, "topic", F.when(F.col("_total") > 0, share).otherwise(0.0).alias("share")
    )


def enriched_profile(
    profiles: DataFrame, distribution: DataFrame, entity: str = "Town"
) -> DataFrame:
    """Profile followed by the topic shares in topic order, scaled to length one."""
    ordered = F.array_sort(F.collect_list(F.struct("topic", "share")))
    shares = distribution.groupBy(entity).agg(ordered["share"].alias("_shares"))
    # entities outside the topic sample have no share of any topic
    width = shares.agg(F.coalesce(F.max(F.size("_shares")), F.lit(0))).scalar()
    filled = F.coalesce(F.col("_shares").cast("array<double>"), F.array_repeat(F.lit(0.0), width))
    joined = profiles.join(shares, entity, "left").withColumn("_shares", filled)
    return joined.select(
        entity, vectors.l2_normalize(vectors.concat_vectors("profile", "_shares")).alias("profile")
    )


def topic_explanation(
    distribution: DataFrame,
    terms: DataFrame,
    top_n: int = 3,
    min_share: float = 0.03,
    entity: str = "Town",
) -> DataFrame:
    """``topicos`` per entity: the ``top_n`` largest shares, of which those below
    ``min_share`` are then dropped; each with its share in percent and a label."""
    order = Window.partitionBy(entity).orderBy(F.desc("share"), "topic")
    top = (
        distribution.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= top_n)
        .where(F.col("share") >= min_share)
    )
    words = F.array_sort(F.collect_list(F.struct("rank", "term")))["term"]
    labels = (
        terms.where(F.col("rank") <= 3)
        .groupBy("topic")
        .agg(F.array_join(words, " · ").alias("label"))
    )
    name = F.concat(F.lit("T"), F.col("topic").cast("string"))
    entry = F.struct(
        "_rank",
        name.alias("topico"),
        round_half_even(F.col("share") * 100, 1).alias("pct"),
        F.coalesce("label", name).alias("label"),
    )
    listed = top.join(labels, "topic", "left").groupBy(entity).agg(
        F.array_sort(F.collect_list(entry)).alias("_entries")
    )
    explained = listed.select(
        entity,
        F.transform(
            "_entries", lambda e: F.struct(e["topico"], e["pct"], e["label"])
        ).cast("array<struct<topico:string,pct:double,label:string>>").alias("topicos"),
    )
    everyone = distribution.select(entity).distinct()
    empty = F.array().cast("array<struct<topico:string,pct:double,label:string>>")
    return everyone.join(explained, entity, "left").select(
        entity, F.coalesce("topicos", empty).alias("topicos")
    )


def dominant_topic_counts(distribution: DataFrame, entity: str = "Town") -> DataFrame:
    """How many entities have each topic as their largest share (lowest topic on ties)."""
    largest = F.max(F.struct("share", (-F.col("topic")).alias("_minus")))
    dominant = distribution.groupBy(entity).agg(largest.alias("_top")).where(
        F.col("_top")["share"] > 0
    )
    return C.count_groups(dominant, (-F.col("_top")["_minus"]).alias("topic"))
