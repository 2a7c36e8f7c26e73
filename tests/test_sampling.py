"""Samples of groups: equal to a plain sort, for any size, with hot groups and odd columns."""

from __future__ import annotations

import hashlib

import pytest
from placelens.operators import sampling
from pyspark.sql import functions as F


def plain(rows, n: int) -> set[int]:
    groups: dict = {}
    for row_id, town in rows:
        groups.setdefault(town, []).append((hashlib.md5(f"42|{row_id}".encode()).hexdigest(), row_id))
    return {row_id for found in groups.values() for _, row_id in sorted(found)[:n]}


def towns(n: int):
    """A hot town with a third of the rows, a town of one row, rows without a town, many small towns."""
    return [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else "one" if i == 1 else f"t{i % 50}") for i in range(n)]


@pytest.mark.parametrize("n", [1, 20, 1500])
def test_random_rows_equal_a_plain_sort(spark, n):
    rows = towns(9000)
    df = spark.createDataFrame(rows, "row_id long, Town string")
    got = sampling.random_n_per_group(df, ["Town"], n).collect()
    assert len(got) == len({r["row_id"] for r in got}) and {r["row_id"] for r in got} == plain(rows, n)


def test_little_more_than_the_sample_is_ranked(spark):
    df = spark.range(200_000).withColumn("Town", F.lit("hot"))
    share = F.conv(F.substr(sampling.shuffle_key(row_id="id"), F.lit(1), F.lit(13)), 16, 10).cast("double") / 2.0**52
    drawn = sampling.draw_at_least(df, ["Town"], share, 5000).count()
    assert 5000 <= drawn < 6000


def test_names_of_helper_columns_may_be_taken(spark):
    rows = [(i, "a", i, i, i, i, i, "x") for i in range(30)]
    names = "row_id long, Town string, _slice long, _RANK long, _key long, _level long, _salt long, _bound string"
    df = spark.createDataFrame(rows, names)
    for got in (sampling.random_n_per_group(df, ["Town"], 5), sampling.first_n_per_group(df, ["Town"], ["row_id"], 5)):
        assert got.columns == df.columns
        assert got.count() == 5 and got.where("_slice = row_id and _rank = row_id and _key = row_id").count() == 5
    assert {r["row_id"] for r in sampling.random_n_per_group(df, ["Town"], 5).collect()} == plain([r[:2] for r in rows], 5)


def test_nothing_to_sample(spark):
    assert sampling.random_n_per_group(spark.createDataFrame([], "row_id long, Town string"), ["Town"], 5).count() == 0
