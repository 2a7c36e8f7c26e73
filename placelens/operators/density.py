"""Density clusters of a bounded sample, with outliers.

Rows are joined by their mutual reachability: the larger of their distance and of both rows' core distances, which
is how far the ``neighbours``-th other row is. A minimum spanning tree of that graph is found in rounds: in the
grid of all pairs every row gives its lightest edge out of its component, Spark takes the lightest of each component,
and components are joined along them. Edges are compared by weight and then by their rows, so the tree is unique.

Cutting the tree's edges from the heaviest down splits the rows; a split into two groups of at least
``minimum`` rows makes two clusters, smaller groups just fall out. Clusters are kept where they last longest for their
rows. The tree has an edge less than rows and is read on the driver, so the rows are bounded by ``MOST_ROWS``: take
a sample first, as ``sampling.balanced_sample`` does.

Distances are those of unit vectors, ``sqrt(2 - 2 cos)``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .neighbours import cosine_search

MOST_ROWS = 200_000
OUTLIER = -1
LEAST_DISTANCE = 1e-6  # what lies closer counts as this far
GRID = {"left_block": 512, "right_block": 4096}


def _distance(similarity: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * similarity))


def core_distances(rows: DataFrame, neighbours: int, row_id: str = "row_id", vector: str = "embedding") -> DataFrame:
    """``rows`` (row_id, vector) and ``core``, the distance of the ``neighbours``-th other row; of the last if
    there are fewer."""
    asked = rows.select(F.col(row_id).alias("_asked"), vector)
    near = cosine_search(asked, rows, neighbours + 1, "_asked", vector, row_id, vector)  # the row itself is among them
    far = near.groupBy(F.col("_asked").alias(row_id)).agg(F.max(_distance(F.col("similarity"))).alias("core"))
    return rows.join(far, row_id)


def spanning_tree(rows: DataFrame, row_id: str = "row_id", vector: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """Of ``rows`` (row_id, vector, core): sorted ids, and the edges (weight, place, place) by weight."""
    some = rows.select(row_id).limit(MOST_ROWS + 1).toArrow().column(0).to_numpy()
    if len(some) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows; take a sample")
    ids = np.sort(some)
    label = np.arange(len(ids))
    left = rows.select(F.col(row_id).alias("_a"), F.col(vector).alias("_x"), F.col("core").alias("_core_a")).persist()
    right = rows.select(F.col(row_id).alias("_b"), F.col(vector).alias("_y"), F.col("core").alias("_core_b")).persist()
    edges: dict[tuple[int, int], float] = {}
    try:
        while len(edges) < len(ids) - 1:
            pairs = blocks.block_join(
                left, right, "_a", "_b", _lightest(ids, label), "component long, w double, lo long, hi long",
                left_rows=len(ids), right_rows=len(ids), **GRID)
            best = pairs.groupBy("component").agg(F.min(F.struct("w", "lo", "hi")).alias("e")).select("e.*").distinct()
            for w, lo, hi in best.orderBy("w", "lo", "hi").collect():  # at most an edge for each component
                edges[int(np.searchsorted(ids, lo)), int(np.searchsorted(ids, hi))] = w
            label = _components(len(ids), edges)
    finally:
        left.unpersist()
        right.unpersist()
    table = np.array([(w, a, b) for (a, b), w in edges.items()]).reshape(-1, 3)
    return ids, table[np.lexsort((table[:, 2], table[:, 1], table[:, 0]))]


def _lightest(ids: np.ndarray, label: np.ndarray):
    """Of two blocks, for each component of the left one its lightest edge to another component."""

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        b = blocks.sort_by(b, "_b")
        x, y = a.column("_a").to_numpy(), b.column("_b").to_numpy()
        own, other = label[np.searchsorted(ids, x)], label[np.searchsorted(ids, y)]
        w = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * blocks.cosine(a, b, "_x", "_y")))
        w = np.maximum(w, np.maximum(a.column("_core_a").to_numpy()[:, None], b.column("_core_b").to_numpy()))
        w[own[:, None] == other] = np.inf
        at = w.argmin(axis=1)  # of equal weights the smallest id, which is also the first in the order of edges
        w = w[np.arange(len(x)), at]
        lo, hi = np.minimum(x, y[at]), np.maximum(x, y[at])
        order = np.lexsort((hi, lo, w, own))
        order = order[np.isfinite(w[order])]
        first = np.ones(len(order), bool)
        first[1:] = own[order][1:] != own[order][:-1]
        order = order[first]
        return pa.table({"component": own[order], "w": w[order], "lo": lo[order], "hi": hi[order]})

    return kernel


def _components(n: int, edges) -> np.ndarray:
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return np.array([root(x) for x in range(n)])


@dataclass
class Cluster:
    """A node of the condensed tree. ``rows`` fell out of it while it lasted; the others went to ``children``."""

    parent: int
    birth: float
    stability: float = 0.0
    rows: list[int] = field(default_factory=list)
    children: list[int] = field(default_factory=list)


def condensed_tree(n: int, edges: np.ndarray, minimum: int) -> list[Cluster]:
    """Clusters of the tree whose edges come sorted by weight; the first holds all rows. A parent stands before
    its children. Levels are inverse distances."""
    left, right, size, level = [], [], [1] * n, []
    top, parent = list(range(n)), list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for w, a, b in edges:
        a, b = root(int(a)), root(int(b))
        left.append(top[a])
        right.append(top[b])
        size.append(size[top[a]] + size[top[b]])
        level.append(1.0 / max(w, LEAST_DISTANCE))
        parent[b] = a
        top[a] = n + len(level) - 1

    def below(node: int) -> list[int]:
        out, work = [], [node]
        while work:
            node = work.pop()
            if node < n:
                out.append(node)
            else:
                work += (left[node - n], right[node - n])
        return out

    clusters = [Cluster(-1, 0.0)]
    work = [(2 * n - 2, 0)] if n else []
    while work:
        node, c = work.pop()
        own = clusters[c]
        while True:
            if node < n:  # a single row: its cluster ends with it
                own.rows.append(node)
                break
            a, b, at = left[node - n], right[node - n], level[node - n]
            if size[a] >= minimum and size[b] >= minimum:
                own.stability += (at - own.birth) * size[node]
                for child in (a, b):
                    own.children.append(len(clusters))
                    work.append((child, len(clusters)))
                    clusters.append(Cluster(c, at))
                break
            small, large = (a, b) if size[a] < size[b] else (b, a)
            if size[large] < minimum:
                own.stability += (at - own.birth) * size[node]
                own.rows += below(node)
                break
            own.stability += (at - own.birth) * size[small]
            own.rows += below(small)
            node = large
    return clusters


def stable_clusters(clusters: list[Cluster], most: int) -> list[int]:
    """Clusters that last longest for their rows, none within another; the first cluster only if ``most`` is 1.
    While there are more than ``most``, the two siblings are joined that lose least."""
    value, chosen = [c.stability for c in clusters], [False] * len(clusters)
    for k in range(len(clusters) - 1, 0, -1):
        inside = sum(value[x] for x in clusters[k].children)
        chosen[k] = not clusters[k].children or clusters[k].stability >= inside
        value[k] = max(clusters[k].stability, inside)
    if most == 1:
        return [0] if clusters[0].children else []
    taken, work = set(), list(clusters[0].children)
    while work:
        k = work.pop()
        if chosen[k]:
            taken.add(k)
        else:
            work += clusters[k].children
    while len(taken) > most:
        pairs = {clusters[k].parent for k in taken if all(x in taken for x in clusters[clusters[k].parent].children)} - {0}
        loss = lambda p: sum(clusters[x].stability for x in clusters[p].children) - clusters[p].stability
        p = min(pairs, key=lambda p: (loss(p), p))
        taken = taken.difference(clusters[p].children) | {p}
    return sorted(taken)


def density_labels(ids: np.ndarray, edges: np.ndarray, minimum: int, most: int) -> np.ndarray:
    """Cluster of each row, the largest first (ties: the smallest row), ``OUTLIER`` for rows in none."""
    label = np.full(len(ids), OUTLIER)
    clusters = condensed_tree(len(ids), edges, minimum)
    groups = []
    for k in stable_clusters(clusters, most):
        rows, work = [], [k]
        while work:
            c = clusters[work.pop()]
            rows += c.rows
            work += c.children
        groups.append(sorted(rows))
    for k, rows in enumerate(sorted(groups, key=lambda rows: (-len(rows), rows[0]))):
        label[rows] = k
    return label


def density_clusters(
    rows: DataFrame, minimum: int, most: int, neighbours: int | None = None, row_id: str = "row_id", vector: str = "embedding"
) -> DataFrame:
    """(row_id, cluster) of the rows: at most ``most`` clusters of at least ``minimum`` rows, -1 for outliers.
    Row ids must differ."""
    table = core_distances(rows.select(F.col(row_id).cast("long").alias(row_id), vector), neighbours or minimum, row_id, vector).persist()
    try:
        ids, edges = spanning_tree(table, row_id, vector)
        label = density_labels(ids, edges, minimum, most)
    finally:
        table.unpersist()
    return rows.sparkSession.createDataFrame(pa.table({row_id: ids.astype(np.int64), "cluster": label.astype(np.int32)}))
