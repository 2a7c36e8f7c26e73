"""k-means over entity profiles with restarts, chosen by cosine silhouette.

All numbers of clusters and all starts are fitted together: a round is one pass over the vectors that gives, for
every model still moving, the sums of its clusters, added up by Spark. Starting centres are drawn by squared
distance with numbers that depend on seed, start and entity only, so neither order nor partitioning matters; the
starts of all numbers of clusters share one draw, of which each takes as many centres as it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import cluster_colour

TOLERANCE = 1e-6  # a model stands when no centre moves further
AT_ONCE = 1 << 22  # distances that a task holds


def matrix(column: pa.Array) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1)


def to_features(profiles: DataFrame, entity: str = "Town", vector: str = "profile") -> DataFrame:
    """(entity, features) with vectors of doubles."""
    return profiles.select(entity, F.col(vector).cast("array<double>").alias("features"))


@dataclass
class Centres:
    """A fitted model: its centres, the sum of squared distances to them and the sizes of its clusters."""

    centres: np.ndarray
    start: int = 0
    cost: float = np.nan
    sizes: np.ndarray | None = None

    @property
    def k(self) -> int:
        return len(self.centres)

    def assign(self, features: DataFrame, entity: str = "Town") -> DataFrame:
        """(entity, cluster): the nearest centre, the first on ties."""
        centres = self.centres

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                nearest = _distances(matrix(batch.column(1)), centres).argmin(axis=1) if batch.num_rows else np.zeros(0)
                yield pa.record_batch([batch.column(0), pa.array(nearest.astype(np.int32))], [entity, "cluster"])

        return features.select(entity, "features").mapInArrow(run, f"`{entity}` {features.schema[entity].dataType.simpleString()}, cluster int")


@dataclass
class Clustering:
    k: int
    silhouette: float
    inertia: float
    model: Centres

    def assign(self, features: DataFrame, entity: str = "Town") -> DataFrame:
        return self.model.assign(features, entity)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2.0 * (x @ centres.T) + (centres * centres).sum(axis=1), 0.0)


def _slices(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose distances to ``width`` centres are held together."""
    rows = max(1, AT_ONCE // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def added(frame: DataFrame, make: Callable[[Iterable[pa.RecordBatch]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sum over all tasks of the arrays that ``make`` gives for each key of a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make(batches)
        yield pa.record_batch([pa.array(list(made), pa.int64()), pa.array([x.tobytes() for x in made.values()], pa.binary())], ["key", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("part"))
        return pa.table({"key": table.column("key")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    schema = "key long, part binary"
    rows = frame.mapInArrow(run, schema).groupBy("key").applyInArrow(add, schema).collect()
    return {r["key"]: np.frombuffer(bytes(r["part"]), np.float64) for r in rows}


def model_sums(features: DataFrame, models: list[np.ndarray]) -> list[np.ndarray]:
    """One pass for all models: for each of its centres a row of (rows, squared distances, sum of the vectors) of the
    vectors nearest to it."""
    stacked = np.concatenate(models)
    ends = np.cumsum([len(m) for m in models])
    wide = stacked.shape[1]

    def make(batches: Iterable[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out = [np.zeros((len(m), wide + 2)) for m in models]
        for batch in _slices(batches, len(stacked)):
            x = matrix(batch.column(0))
            d = _distances(x, stacked)
            for total, end in zip(out, ends, strict=True):
                own = d[:, end - len(total):end]
                nearest = own.argmin(axis=1)
                total[:, 0] += np.bincount(nearest, minlength=len(total))
                total[:, 1] += np.bincount(nearest, own[np.arange(len(x)), nearest], minlength=len(total))
                chosen = np.zeros((len(total), len(x)))
                chosen[nearest, np.arange(len(x))] = 1.0
                total[:, 2:] += chosen @ x
        return dict(enumerate(out))

    found = added(features.select("features"), make)
    return [found[k].reshape(len(m), wide + 2) for k, m in enumerate(models)]


def _uniform(h: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in (0, 1) from hashes and whole numbers."""
    with np.errstate(over="ignore"):
        x = h.astype(np.int64).view(np.uint64)
        for k in salt:
            x = (x ^ np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = x ^ (x >> np.uint64(27))
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54


def starting_centres(features: DataFrame, k: int, starts: int, seed: int, entity: str = "Town") -> list[np.ndarray]:
    """``k`` centres for each start, each drawn with a probability that goes with the squared distance to those
    drawn before. A draw is the least of exponential numbers, whose rate is the distance: one pass for all starts."""
    keyed = features.select(F.xxhash64(entity).alias("h"), "features")
    drawn: list[list[np.ndarray]] = [[] for _ in range(starts)]
    for step in range(k):
        ready = [np.array(x) for x in drawn]

        def draw(batches: Iterable[pa.RecordBatch], step=step, ready=ready) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple] = {}
            for batch in _slices(batches, starts * max(1, step)):
                x, h = matrix(batch.column("features")), batch.column("h").to_numpy()
                for start, centres in enumerate(ready):
                    rate = _distances(x, centres).min(axis=1) if step else np.ones(len(x))
                    wait = -np.log(_uniform(h, seed, start, step)) / np.maximum(rate, 1e-200)
                    at = int(np.lexsort((h, wait))[0])
                    best[start] = min(best.get(start, (np.inf,)), (wait[at], int(h[at]), x[at].tolist()))
            yield pa.record_batch(
                [pa.array(list(best), pa.int32()), pa.array([b[0] for b in best.values()], pa.float64()),
                 pa.array([b[1] for b in best.values()], pa.int64()), pa.array([b[2] for b in best.values()], pa.list_(pa.float64()))],
                ["start", "wait", "h", "x"])

        rows = keyed.mapInArrow(draw, "start int, wait double, h long, x array<double>")
        first = rows.groupBy("start").agg(F.min_by("x", F.struct("wait", "h")).alias("x")).collect()
        for r in first:
            drawn[r["start"]].append(np.array(r["x"]))
    return [np.array(x) for x in drawn]


def fit_all(features: DataFrame, ks: list[int], n_init: int, seed: int, max_iter: int, entity: str = "Town") -> list[Centres]:
    """Every number of clusters with every start, in common rounds. A cluster that loses its rows keeps its centre."""
    starts = starting_centres(features, max(ks), n_init, seed, entity)
    models = [Centres(centres[:k].copy(), start) for k in ks for start, centres in enumerate(starts)]
    moving = list(range(len(models)))
    for _ in range(max_iter):
        sums = model_sums(features, [models[m].centres for m in moving])
        still = []
        for m, total in zip(moving, sums, strict=True):
            some = total[:, 0] > 0
            centres = models[m].centres.copy()
            centres[some] = total[some, 2:] / total[some, :1]
            if np.sqrt(((centres - models[m].centres) ** 2).sum(axis=1)).max() > TOLERANCE:
                still.append(m)
            models[m].centres = centres
        moving = still
        if not moving:
            break
    for model, total in zip(models, model_sums(features, [m.centres for m in models]), strict=True):
        model.cost, model.sizes = float(total[:, 1].sum()), total[:, 0].astype(np.int64)
    return models


def kmeans_restarts(
    features: DataFrame, k: int, n_init: int = 15, seed: int = 42, max_iter: int = 300, entity: str = "Town"
) -> Centres:
    """Best of ``n_init`` seeded runs by within-cluster cost; earliest start on ties."""
    features = features.persist()
    try:
        return min(fit_all(features, [k], n_init, seed, max_iter, entity), key=lambda m: (m.cost, m.start))
    finally:
        features.unpersist()


def _units(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1))
    return x / np.where(length > 0, length, 1.0)[:, None]


def _silhouette_sums(u: np.ndarray, own: np.ndarray, n: np.ndarray, sums: np.ndarray) -> float:
    """Sum of the silhouettes of unit vectors in clusters ``own`` of ``n`` rows and these vector sums."""
    away = 1.0 - (u @ sums.T) / np.maximum(n, 1)
    rows = np.arange(len(u))
    inside = away[rows, own] * n[own] / np.maximum(n[own] - 1, 1)
    away[rows, own] = np.inf
    away[:, n == 0] = np.inf
    outside = away.min(axis=1)
    larger = np.maximum(inside, outside)
    with np.errstate(invalid="ignore"):
        s = np.where((n[own] > 1) & np.isfinite(outside) & (larger > 0), (outside - inside) / larger, 0.0)
    return float(s.sum())


def silhouettes(features: DataFrame, models: list[Centres]) -> list[float]:
    """Mean silhouette with cosine distance of every model, in two passes for all of them: the distances to a cluster
    come from the sum of its unit vectors. 0 where all rows are in one cluster."""
    sets = [m.centres for m in models]
    width = sum(map(len, sets))

    def assigned(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        for batch in _slices(batches, width):
            x = matrix(batch.column(0))
            yield _units(x), [_distances(x, c).argmin(axis=1) for c in sets]

    def sums(batches: Iterable[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out = [np.zeros((len(c), c.shape[1] + 1)) for c in sets]
        for u, owns in assigned(batches):
            for total, own in zip(out, owns, strict=True):
                total[:, 0] += np.bincount(own, minlength=len(total))
                np.add.at(total[:, 1:], own, u)
        return dict(enumerate(out))

    vectors = features.select("features")
    found = added(vectors, sums)
    totals = [found[k].reshape(len(c), -1) for k, c in enumerate(sets)]

    def scores(batches: Iterable[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out = np.zeros(len(sets))
        for u, owns in assigned(batches):
            for k, own in enumerate(owns):
                out[k] += _silhouette_sums(u, own, totals[k][:, 0], totals[k][:, 1:])
        return {0: out}

    score = added(vectors, scores)[0]
    return [float(score[k] / totals[k][:, 0].sum()) if (totals[k][:, 0] > 0).sum() > 1 else 0.0 for k in range(len(sets))]


def silhouette_cosine(labelled: DataFrame, label: str = "cluster") -> float:
    """Mean silhouette with cosine distance of a frame with ``features`` and given labels, of which there may be
    no more than clusters: their sums are sent to every task. 0 for a single label."""
    rows = labelled.select("features", F.col(label).cast("long").alias("label"))

    def sums(batches: Iterable[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for batch in _slices(batches, 1):
            u, own = _units(matrix(batch.column(0))), batch.column(1).to_numpy()
            for x in np.unique(own).tolist():
                some = u[own == x]
                out[x] = out.get(x, 0.0) + np.concatenate(([len(some)], some.sum(axis=0)))
        return out

    found = added(rows, sums)
    names = np.array(sorted(found))
    if len(names) < 2:
        return 0.0
    totals = np.array([found[x] for x in names.tolist()])

    def scores(batches: Iterable[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = 0.0
        for batch in _slices(batches, len(names)):
            own = np.searchsorted(names, batch.column(1).to_numpy())
            total += _silhouette_sums(_units(matrix(batch.column(0))), own, totals[:, 0], totals[:, 1:])
        return {0: np.array([total])}

    return float(added(rows, scores)[0][0] / totals[:, 0].sum())


def sweep(
    features: DataFrame, k_max: int = 10, n_init: int = 15, seed: int = 42, max_iter: int = 300, entity: str = "Town"
) -> list[Clustering]:
    """One clustering for every k from 2 to ``min(k_max, rows) - 1``: the start of the least cost."""
    features = features.persist()
    try:
        ks = list(range(2, min(k_max, features.count())))
        if not ks:
            return []
        fits = fit_all(features, ks, n_init, seed, max_iter, entity)
        best = [min((m for m in fits if m.k == k), key=lambda m: (m.cost, m.start)) for k in ks]
        return [Clustering(m.k, s, m.cost, m) for m, s in zip(best, silhouettes(features, best), strict=True)]
    finally:
        features.unpersist()


def choose_k(clusterings: list[Clustering]) -> Clustering:
    """Highest silhouette; the smallest k on ties."""
    return max(clusterings, key=lambda c: (c.silhouette, -c.k))


def sweep_table(spark, clusterings: list[Clustering]) -> DataFrame:
    """(k, silhouette, inertia, best): the silhouette and elbow curves."""
    best = choose_k(clusterings).k if clusterings else None
    rows = [(c.k, float(c.silhouette), float(c.inertia), c.k == best) for c in clusterings]
    return spark.createDataFrame(rows, "k int, silhouette double, inertia double, best boolean")


def with_cluster_colour(assigned: DataFrame) -> DataFrame:
    return assigned.withColumn("color", cluster_colour("cluster"))


def compare_clusterings(variants: dict[str, DataFrame], **settings) -> DataFrame:
    """Best k and silhouette per named variant of the features."""
    tables = []
    for name, features in variants.items():
        table = sweep_table(features.sparkSession, sweep(features, **settings))
        tables.append(
            table.where("best").select(F.lit(name).alias("variant"), "k", "silhouette")
        )
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result
