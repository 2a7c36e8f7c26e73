"""The review views over the generated tables. Whole tables, every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import clean_reviews


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw reviews: all strings, with missing, out-of-range and fractional
    polarity so that the cleaning has something to do."""
    documents = table(spark, sf_dir, "documents")
    region = table(spark, sf_dir, "region")
    doc_id = F.col("doc_id")
    polarity = (
        F.when(doc_id % 41 == 0, "n/a")
        .when(doc_id % 43 == 0, "7")
        .when(doc_id % 53 == 0, "4.7")
        .when(doc_id % 59 == 0, "0.9")
        .otherwise((1 + (doc_id * 31 + F.col("n_chars")) % 5).cast("string"))
    )
    key = F.substr("source", F.lit(4)).cast("int") % 5
    return documents.join(region, F.col("r_regionkey") == key).select(
        doc_id.alias("row_id"),
        F.split_part("text", F.lit(" "), F.lit(1)).alias("Title"),
        F.col("text").alias("Review"),
        F.col("source").alias("Town"),
        F.col("r_name").alias("Region"),
        F.when(doc_id % 47 != 0, F.col("lang")).alias("Type"),
        polarity.alias("Polarity"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_reviews(reviews_raw(spark, sf_dir))


def review_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.concat(F.lit("T"), F.col("label").cast("string")).alias("Town"),
        (1 + F.col("vec_id") % 5).cast("int").alias("Polarity"),
        "embedding",
        "label",
    )


def vector_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``review_vectors`` with the columns that metadata needs: the region by label and the
    language of the document with the same id (``en`` if there is none) as the type."""
    region = table(spark, sf_dir, "region")
    languages = table(spark, sf_dir, "documents").select("doc_id", "lang")
    vectors = review_vectors(spark, sf_dir)
    return (
        vectors.join(region, F.col("label") % 5 == F.col("r_regionkey"))
        .join(languages, F.col("row_id") == F.col("doc_id"), "left")
        .select(
            "row_id",
            "Town",
            F.col("r_name").alias("Region"),
            F.coalesce("lang", F.lit("en")).alias("Type"),
            "Polarity",
            "embedding",
        )
    )


def review_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label plays the topic (9 = outlier); the town is independent of it."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.concat(F.lit("S"), (F.col("vec_id") % 20).cast("string")).alias("Town"),
        F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("topic"),
        "embedding",
    )
