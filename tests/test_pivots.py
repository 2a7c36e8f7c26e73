"""Search and closest pairs by pivots equal the full grid and brute force, and meet fewer rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from placelens.operators import neighbours, pivots
from placelens.session import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def grouped(n: int, groups: int, width: int = 16, seed: int = 7) -> np.ndarray:
    """Vectors around few centres, with exact copies and a zero vector."""
    random = np.random.default_rng(seed)
    made = random.normal(size=(groups, width))[np.arange(n) % groups] + 0.05 * random.normal(size=(n, width))
    made[n // 2 : n // 2 + n // 10] = made[0]
    made[-1] = 0.0
    return made


def frame(spark, vectors: np.ndarray, first: str = "row_id long", name=int):
    rows = [(name(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{first}, embedding array<double>")


def ranked(df, key: str):
    return sorted((r["query_id"], r["rank"], r[key], round(r["similarity"], 9)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 7, 60])
def test_search_equals_the_grid(spark, k):
    vectors = grouped(600, 20)
    targets = frame(spark, vectors)
    queries = frame(spark, grouped(90, 20, seed=8), "query_id long")
    found = pivots.search(queries, targets, k, left_block=16, right_block=32)
    assert ranked(found.rows, "row_id") == ranked(
        neighbours.cosine_search(queries, targets, k, target_id="row_id", target_vector="embedding"), "row_id"
    )
    assert found.grid == 90 * 600
    if k < 60:
        assert found.compared < found.grid / 2


def test_search_without_groups_and_with_odd_rows(spark):
    random = np.random.default_rng(3)
    targets = frame(spark, random.normal(size=(150, 8))).unionByName(
        spark.createDataFrame([(1000, None)], "row_id long, embedding array<double>")
    )
    queries = frame(spark, np.vstack([random.normal(size=(20, 8)), np.zeros((1, 8))]), "query_id long")
    plain = neighbours.cosine_search(
        queries, targets.where("embedding is not null"), 9, target_id="row_id", target_vector="embedding"
    )
    assert ranked(pivots.search(queries, targets, 9).rows, "row_id") == ranked(plain, "row_id")
    few = pivots.search(queries, targets.where("row_id < 4"), 9).rows
    assert few.count() == 21 * 4
    nobody = pivots.search(queries, targets.where("row_id < 0"), 9)
    assert nobody.rows.count() == 0 and nobody.grid == 0
    assert pivots.search(queries.where("query_id < 0"), targets, 9).rows.count() == 0


@pytest.mark.parametrize("n, groups", [(2, 1), (40, 40), (400, 16)])
def test_closest_pairs_equal_the_grid(spark, n, groups):
    profiles = frame(spark, grouped(n, groups), "Town string", "t{:04d}".format).withColumnRenamed("embedding", "profile")
    found = pivots.closest_pairs(profiles, 12, block=16)
    plain = neighbours.most_similar_pairs(profiles, 12)
    pairs = lambda df: [(r["entity_a"], r["entity_b"], round(r["similarity"], 9)) for r in df.collect()]
    assert pairs(found.rows) == pairs(plain)
    assert found.grid == n * (n - 1) // 2 and found.compared <= found.grid
    if n == 400:
        assert found.compared < found.grid / 2


def test_no_pairs(spark):
    nobody = spark.createDataFrame([], "Town string, profile array<double>")
    assert pivots.closest_pairs(nobody).rows.count() == 0
    one = spark.createDataFrame([("A", [1.0])], "Town string, profile array<double>")
    assert pivots.closest_pairs(one).rows.count() == 0


def test_copies_of_queries_leave_a_task_in_bounded_batches():
    """Without groups every query visits every cell: one batch held all copies of its rows."""
    table = pa.table({"query_id": range(2000), "_asked": [[float(k), 1.0] for k in range(2000)]})
    row, cell = np.nonzero(np.ones((2000, 30), bool))
    found = list(pivots._copies(table, row, cell))
    assert max(b.num_rows for b in found) <= pivots.VISITS
    made = pa.Table.from_batches(found)
    assert made.column("query_id").to_pylist() == row.tolist() and made.column("_cell").to_pylist() == cell.tolist()
