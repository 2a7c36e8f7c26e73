"""Results kept between runs: parquet frames, JSON metrics."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS_SCHEMA = (
    "method string, n_eval long, `HR@1` double, `HR@3` double, `HR@5` double, "
    "`HR@10` double, MRR double, `NDCG@5` double, rank_mean double"
)
_SETS, _LIST = "sets", "list"
_LINE = "set_name string, folder string, names array<string>, written long"


def fingerprint(parameters: Mapping[str, object] | None = None, **inputs: DataFrame) -> str:
    """Name of what is built from these inputs with these parameters (anything JSON can hold).

    An input counts with its schema, its number of rows and the sum of its rows' hashes: one scan, one row to
    the driver, the same for any order and partitioning. Maps cannot be hashed and must be left out.
    """
    parts = {"parameters": dict(parameters or {})}
    for name, frame in sorted(inputs.items()):
        names = sorted(frame.columns)
        row = F.xxhash64(*[F.col(f"`{c}`") for c in names], F.array(*[F.col(f"`{c}`").isNull() for c in names]))
        found = frame.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("sum")).first()
        types = {f.name: f.dataType.simpleString() for f in frame.schema}
        parts[f"input {name}"] = [types, found["n"], str(found["sum"])]
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def save_artifacts(path: str, /, *, set_name: str = "", **frames: DataFrame) -> None:
    """Write a set of frames as parquet to a folder of its own, then the line of the list that commits it.

    A set without its line is never loaded, so a run that died half way is simply built again. No folder is
    written twice: a set that another job reads stays as it is, and the newest line of a name counts.
    """
    spark = next(iter(frames.values())).sparkSession
    folder = uuid.uuid4().hex
    for name, frame in frames.items():
        frame.write.parquet(f"{path}/{_SETS}/{folder}/{name}")
    line = spark.createDataFrame([(set_name, folder, list(frames), time.time_ns())], _LINE)
    line.coalesce(1).write.mode("append").parquet(f"{path}/{_LIST}")


def load_artifacts(spark: SparkSession, path: str, set_name: str = "") -> dict[str, DataFrame] | None:
    """Frames by name of the newest complete set of that name, or None if there is none."""
    try:
        lines = spark.read.schema(_LINE).parquet(f"{path}/{_LIST}")
        newest = lines.where(F.col("set_name") == set_name).orderBy(F.desc("written"), "folder").first()
    except AnalysisException:
        return None
    if newest is None:
        return None
    return {name: spark.read.parquet(f"{path}/{_SETS}/{newest['folder']}/{name}") for name in newest["names"]}


def load_or_build(
    spark: SparkSession, path: str, build: Callable[[], Mapping[str, DataFrame]], set_name: str = ""
) -> dict[str, DataFrame]:
    """Saved frames if complete, else ``build()`` them, save them and read them back, so
    that what follows starts from files and not from a long lineage. With a ``fingerprint`` as the name,
    other inputs or parameters build another set."""
    loaded = load_artifacts(spark, path, set_name)
    if loaded is None:
        save_artifacts(path, set_name=set_name, **build())
        loaded = load_artifacts(spark, path, set_name)
    return loaded


def write_metrics(record: DataFrame, path: str) -> None:
    record.coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).json(path)


def metrics_or_evaluate(
    spark: SparkSession, path: str, evaluate: Callable[[], DataFrame]
) -> DataFrame:
    """Saved evaluation record, or a new one that is saved."""
    try:
        saved = read_metrics(spark, path)
    except AnalysisException:
        write_metrics(evaluate(), path)
        saved = read_metrics(spark, path)
    return saved


def save_topics(path: str, assigned: DataFrame, terms: DataFrame, distribution: DataFrame) -> None:
    save_artifacts(path, assigned=assigned, terms=terms, distribution=distribution)


def load_topics(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    return load_artifacts(spark, path)
