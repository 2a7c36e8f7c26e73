"""Term frequencies, complaint categories and lexical diversity."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.constants import (
    COMPLAINT_LEXICON,
    NO_COMPLAINT,
    STOPWORDS_ENTITY,
    STOPWORDS_FREQUENCY,
)
from .entities import rank_entities_by_count
from . import counts as C


def term_counts(
    df: DataFrame,
    keys: list[str],
    column: str = "Review",
    min_len: int = 4,
    stopwords: Collection[str] = STOPWORDS_FREQUENCY,
) -> DataFrame:
    """``keys, term, n``. Words are exploded and filtered as rows inside generated code and
    counted map-side, so a shuffle carries distinct terms per task, not words."""
    words = df.select(*keys, F.explode(text.words(column, min_len)).alias("term"))
    if stopwords:
        words = words.where(~F.col("term").isin(sorted(stopwords)))
    return C.count_groups(words, *keys, "term")


def _top_terms(counts: DataFrame, keys: list[str], k: int, score: str = "n") -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), "term")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def term_frequency_by_class(
    reviews: DataFrame, k: int = 80, stopwords: Collection[str] = STOPWORDS_FREQUENCY
) -> DataFrame:
    """Most frequent terms of very positive (5) and of negative (<= 2) reviews."""
    label = F.when(F.col("Polarity") == 5, "positive").when(F.col("Polarity") <= 2, "negative")
    marked = reviews.withColumn("class", label).where(F.col("class").isNotNull())
    return _top_terms(term_counts(marked, ["class"], stopwords=stopwords), ["class"], k)


def term_frequency_by_entity(
    reviews: DataFrame,
    cells: DataFrame,
    stats: DataFrame,
    k: int = 60,
    n_entities: int = 9,
    stopwords: Collection[str] = STOPWORDS_ENTITY,
    entity: str = "Town",
) -> DataFrame:
    """Most frequent terms of the most reviewed entities, with their statistics."""
    chosen = rank_entities_by_count(cells, n_entities, entity).select(entity)
    own = reviews.join(chosen, entity, "left_semi")
    top = _top_terms(term_counts(own, [entity], stopwords=stopwords), [entity], k)
    return top.join(stats.select(entity, "Region", "n_reviews", "mean_polarity"), entity)


def complaint_matrix(
    reviews: DataFrame,
    lexicon: Mapping[str, Sequence[str]] = COMPLAINT_LEXICON,
    default: str = NO_COMPLAINT,
    min_n: int = 10,
    entity: str = "Town",
) -> DataFrame:
    """Share of every complaint category among an entity's negative reviews, in percent,
    for entities with at least ``min_n`` of them."""
    negative = reviews.where(F.col("Polarity") <= 2).select(
        entity, text.classify_complaint("Review", lexicon, default).alias("complaint")
    )
    categories = [*lexicon, default]
    counts = C.count_groups(negative, entity, "complaint")
    wide = counts.groupBy(entity).agg(
        F.sum("n").alias("n_negative"),
        *[
            F.sum(F.when(F.col("complaint") == c, F.col("n")).otherwise(0)).alias(c)
            for c in categories
        ],
    )
    return wide.where(F.col("n_negative") >= min_n).select(
        entity,
        "n_negative",
        *[(F.col(f"`{c}`") / F.col("n_negative") * 100).alias(c) for c in categories],
    )


def lexical_diversity(
    reviews: DataFrame, stopwords: Collection[str] = STOPWORDS_ENTITY, entity: str = "Town"
) -> DataFrame:
    """Total and distinct words and their ratio per entity. Distinct words are counted as
    rows of the term counts: no second pass and no expand for a distinct aggregate."""
    vocabulary = (
        term_counts(reviews, [entity], stopwords=stopwords)
        .groupBy(entity)
        .agg(F.sum("n").alias("total_words"), F.count(F.lit(1)).alias("unique_words"))
    )
    sizes = C.count_groups(reviews, entity).withColumnRenamed("n", "n_reviews")
    joined = sizes.join(vocabulary, entity, "left").na.fill(0, ["total_words", "unique_words"])
    ratio = F.col("unique_words") / F.greatest(F.col("total_words"), F.lit(1))
    return joined.select(
        entity, "total_words", "unique_words", ratio.alias("ttr"), "n_reviews"
    ).orderBy(F.desc("unique_words"), entity)


def lexical_top(diversity: DataFrame, k: int = 20, entity: str = "Town") -> DataFrame:
    return diversity.orderBy(F.desc("unique_words"), entity).limit(k)


def lexical_ttr(diversity: DataFrame, min_n: int = 100, entity: str = "Town") -> DataFrame:
    enough = diversity.where(F.col("n_reviews") >= min_n)
    return enough.orderBy(F.desc("ttr"), F.desc("unique_words"), entity)
