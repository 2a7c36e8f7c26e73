"""From documents to token ids, stage by stage: languages, exact copies, near copies, benchmark, tokens."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from placelens.llm import backtrack_bpe, grace_dedup, jaccard_join, language_evidence, latent_decontamination
from placelens.session import ship, written

#: Bytes of the rows that Spark hands to a Python worker at a time; by itself it takes 10,000 rows, however long
#: their texts are, and holds them several times over, in the JVM and in the worker.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go."""
    return language_evidence.accepted_documents(docs, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of the largest id stays."""
    return grace_dedup.drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of the smallest id stays."""
    return jaccard_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return latent_decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left, with digests of the ids and of what they decode to."""
    return backtrack_bpe.tokenized(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _in_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, value in BATCH.items():
            if spark.conf.get(key, None) is None:  # what the session sets holds
                spark.conf.set(key, value)
        return stage(spark, docs, sf_dir)

    run.__doc__ = stage.__doc__
    return run


STAGES = [
    ("language", _in_batches(language)),
    ("exact copies", _in_batches(exact_copies)),
    ("near copies", _in_batches(near_copies)),
    ("benchmark", _in_batches(benchmark)),
    ("tokens", _in_batches(tokens)),
]
#: Language models, latent vectors and merges are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read by the next."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
