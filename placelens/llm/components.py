"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


#: Rows that are worth a task of their own.
TASK_ROWS = 100_000
LEAST_TASKS = 32


def in_few_tasks(df: DataFrame, most_rows: int) -> DataFrame:
    """The last stage of ``df`` in no more tasks than so many rows need: short rounds over small tables would
    otherwise leave the driver a status, a file and events for every shuffle partition."""
    return df.coalesce(min(max(LEAST_TASKS, -(-most_rows // TASK_ROWS)), (1 << 31) - 1))


def stars(edges: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """(u, v) for every node u of ``edges`` (a, b: long; so many rows at most) that is connected to a smaller
    one: v is the smallest; and the number of these rows.

    Alternates two steps until every node points to one that points nowhere: every larger neighbour of a node
    points to the smallest one (large star), then every smaller one does (small star). Neighbours are never
    gathered: each step is a minimum by node, joined back.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = written(in_few_tasks(pairs, rows), "components")
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = in_few_tasks(large.where("u <> v"), rows)  # a row of each pair at most
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = in_few_tasks(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), rows)
        joined = small.unionByName(in_few_tasks(least.select("u", F.col("m").alias("v")), rows))
        # a step makes at most two rows of one
        pairs = written(in_few_tasks(joined.where("u <> v").distinct(), 2 * rows), "components")
        ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("is_root")).unionByName(
            pairs.select(F.col("v").alias("node"), F.lit(0).alias("points"), F.lit(1).alias("is_root"))
        ).groupBy("node").agg(F.sum("points").alias("points"), F.max("is_root").alias("is_root"))
        rows, left = in_few_tasks(ends, 4 * rows).agg(
            F.coalesce(F.sum("points"), F.lit(0)), F.count_if(F.expr("points > 1 or points = 1 and is_root = 1"))
        ).first()
        if not left:
            return pairs, rows


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: long): the smallest node it is connected to."""
    pairs, _ = stars(edges, edges.count())
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
