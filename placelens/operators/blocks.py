"""Exact all-against-all vector work as a grid of bounded blocks.

Both sides are hashed into blocks of bounded size, each block is sent to the grid cells
it takes part in, and Spark cogroups the cells. A task multiplies two blocks and returns
only what the operator needs (the best k per row, a count), so no pair of rows is ever
materialised unless the pairs are the result. Ids are spread by hash, so a popular entity
does not make a heavy cell, and nothing is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEFT_BLOCK = 1024
RIGHT_BLOCK = 8192
# Scores are rounded so that the order of summation cannot decide a tie.
SCORE_DECIMALS = 12

Kernel = Callable[[pa.Table, pa.Table], pa.Table]


def _block_count(df: DataFrame, rows: int | None, size: int) -> Column:
    """Number of blocks: from the given row count, else from a lazy scalar subquery."""
    if rows is not None:
        return F.lit(max(1, -(-rows // size)))
    return F.greatest(F.lit(1), F.ceil(df.agg(F.count(F.lit(1))).scalar() / size).cast("int"))


def block_join(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    kernel: Kernel,
    schema: str,
    left_rows: int | None = None,
    right_rows: int | None = None,
    left_block: int = LEFT_BLOCK,
    right_block: int = RIGHT_BLOCK,
) -> DataFrame:
    """Apply ``kernel(left_block, right_block)`` to every cell of the grid."""
    n_left = _block_count(left, left_rows, left_block)
    n_right = _block_count(right, right_rows, right_block)

    def cells(df: DataFrame, own: str, key: str, n_own: Column, other: str, n_other: Column):
        block = F.pmod(F.xxhash64(key), n_own.cast("long")).cast("int")
        return df.withColumn(own, block).withColumn(
            other, F.explode(F.sequence(F.lit(0), (n_other - 1).cast("int")))
        )

    lhs = cells(left, "_lb", left_id, n_left, "_rb", n_right)
    rhs = cells(right, "_rb", right_id, n_right, "_lb", n_left)
    empty = pa.Table.from_batches([], schema=_arrow_schema(left, schema))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return kernel(a, b) if a.num_rows and b.num_rows else empty

    return (
        lhs.groupBy("_lb", "_rb").cogroup(rhs.groupBy("_lb", "_rb")).applyInArrow(run, schema)
    )


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


# Helpers used inside kernels.


def unit_matrix(table: pa.Table, column: str) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    flat = pc.list_flatten(table.column(column)).to_numpy().astype("float64")
    matrix = flat.reshape(table.num_rows, -1)
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(length > 0, length, 1.0)[:, None]


def cosine(left: pa.Table, right: pa.Table, left_vector: str, right_vector: str) -> np.ndarray:
    product = unit_matrix(left, left_vector) @ unit_matrix(right, right_vector).T
    return np.round(product, SCORE_DECIMALS) + 0.0  # no negative zero


def best_k(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k highest scores per row; equal scores go to the lower column."""
    width = scores.shape[1]
    if width <= k:
        return np.ones(scores.shape, dtype=bool)
    threshold = np.partition(scores, width - k, axis=1)[:, width - k][:, None]
    above = scores > threshold
    tied = scores == threshold
    room = k - above.sum(axis=1, keepdims=True)
    return above | (tied & (np.cumsum(tied, axis=1) <= room))


def sort_by(table: pa.Table, column: str, order: str = "ascending") -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[(column, order)]))


def emit(left: pa.Table, right: pa.Table, mask: np.ndarray, scores: dict) -> pa.Table:
    """Selected pairs: left columns, right columns, then one column per score matrix."""
    rows, columns = np.nonzero(mask)
    left, right = left.take(rows), right.take(columns)
    data = {name: left.column(name) for name in left.column_names}
    data |= {name: right.column(name) for name in right.column_names}
    data |= {name: pa.array(matrix[rows, columns]) for name, matrix in scores.items()}
    return pa.table(data)
