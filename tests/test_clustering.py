"""Shared passes of k-means, silhouettes and the neighbour map against MLlib and plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from placelens.operators import clustering, maps
from placelens.plans import recommend_queries as queries
from placelens.session import ship
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(1)
    return np.concatenate([rng.standard_normal((30, 5)) * 0.3 + 3 * rng.standard_normal(5) for _ in range(4)])


@pytest.fixture(scope="module")
def features(spark, points):
    rows = [(f"T{k}", x.tolist()) for k, x in enumerate(points)]
    return clustering.to_features(spark.createDataFrame(rows, "Town string, profile array<double>").repartition(3))


def mllib(features, k):
    packed = features.withColumn("features", array_to_vector("features"))
    return KMeans(k=k, seed=1).fit(packed), packed


def test_cost_equals_mllib_for_the_same_centres(features):
    fits = [mllib(features, k)[0] for k in (2, 4, 7)]
    sums = clustering.model_sums(features, [np.array(m.clusterCenters()) for m in fits])
    for model, total in zip(fits, sums, strict=True):
        assert abs(total[:, 1].sum() - model.summary.trainingCost) < 1e-9 * max(1, model.summary.trainingCost)
        assert total[:, 0].astype(int).tolist() == model.summary.clusterSizes


def test_models_stand_still_and_are_the_best_of_their_starts(features, points):
    fits = clustering.fit_all(features, [2, 3, 4, 5], 6, 42, 300)
    assert len(fits) == 24
    for m in fits:
        d = ((points[:, None] - m.centres) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        assert abs(d.min(axis=1).sum() - m.cost) < 1e-9 * m.cost and np.bincount(own, minlength=m.k).tolist() == m.sizes.tolist()
        for c in range(m.k):
            assert np.allclose(m.centres[c], points[own == c].mean(axis=0), atol=1e-5)
    for c in clustering.sweep(features, k_max=6, n_init=6):
        assert c.inertia == pytest.approx(min(m.cost for m in fits if m.k == c.k), rel=1e-12)  # sums in any order
        assert c.inertia <= 1.001 * min(mllib(features, c.k)[0].summary.trainingCost, c.inertia * 2)


def test_starts_do_not_depend_on_partitions(features):
    a = clustering.starting_centres(features, 4, 3, 42)
    b = clustering.starting_centres(features.repartition(7), 4, 3, 42)
    assert all((x == y).all() for x, y in zip(a, b, strict=True)) and not (a[0] == a[1]).all()


def test_jobs_of_a_sweep(spark, features, monkeypatch):
    passes = []
    plain = clustering.added
    monkeypatch.setattr(clustering, "added", lambda *a: passes.append(1) or plain(*a))
    found = clustering.sweep(features, k_max=10, n_init=15)
    assert [c.k for c in found] == list(range(2, 10)) and len(passes) < 100


def test_silhouettes_equal_the_evaluator(features):
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="cluster", distanceMeasure="cosine")
    models = [clustering.kmeans_restarts(features, k, 2) for k in (2, 3, 6)]
    for m, s in zip(models, clustering.silhouettes(features, models), strict=True):
        labelled = features.join(m.assign(features), "Town")
        assert abs(s - evaluator.evaluate(labelled.withColumn("features", array_to_vector("features")))) < 1e-9
        assert abs(s - clustering.silhouette_cosine(labelled.withColumn("cluster", F.col("cluster") * 7 - 3))) < 1e-12
    assert clustering.silhouette_cosine(features.withColumn("cluster", F.lit(3))) == 0.0


def test_equal_rows_and_empty_clusters(spark):
    rows = [(f"T{k}", [1.0, 0.0]) for k in range(4)] + [("Z", [0.0, 0.0])]
    df = clustering.to_features(spark.createDataFrame(rows, "Town string, profile array<double>"))
    found = clustering.sweep(df, k_max=5, n_init=2)
    assert [c.k for c in found] == [2, 3, 4] and all(abs(c.inertia) < 1e-12 for c in found)
    assert clustering.sweep(df.limit(2), k_max=5) == []


def ring(spark, n):
    angle = 2 * np.pi * np.arange(n) / n
    rows = [(f"T{k:03d}", [float(np.cos(a)), float(np.sin(a))]) for k, a in enumerate(angle)]
    return spark.createDataFrame(rows, "Town string, profile array<double>")


def test_layout_of_a_ring_is_a_circle(spark):
    places = {r["node"]: (r["x"], r["y"]) for r in maps.neighbour_layout(maps.neighbour_graph(ring(spark, 24), 2)).collect()}
    xy = np.array([places[f"T{k:03d}"] for k in range(24)])
    radius = np.linalg.norm(xy, axis=1)
    assert abs(xy.mean(axis=0)).max() < 0.05 and radius.std() < 0.1 * radius.mean()
    step = np.linalg.norm(xy - np.roll(xy, 1, axis=0), axis=1)
    far = np.linalg.norm(xy - np.roll(xy, 12, axis=0), axis=1)
    assert step.max() < 0.4 * far.min()


def test_axes_are_eigenvectors(spark, points):
    shifted = points[:40] + 4.0
    rows = [(f"T{k:02d}", x.tolist()) for k, x in enumerate(shifted)]
    edges = maps.neighbour_graph(spark.createDataFrame(rows, "Town string, profile array<double>"), 12)
    w = np.zeros((40, 40))
    for r in edges.collect():
        w[int(r["a"][1:]), int(r["b"][1:])] = r["w"]
    assert (w == w.T).all()
    d = w.sum(axis=1)
    values = np.sort(np.linalg.eigvalsh(w / np.sqrt(np.outer(d, d))))[::-1]
    places = {r["node"]: (r["x"], r["y"]) for r in maps.neighbour_layout(edges).collect()}
    xy = np.array([places[f"T{k:02d}"] for k in range(40)])
    assert np.allclose(d @ xy, 0, atol=1e-6) and np.allclose((d[:, None] * xy**2).sum(axis=0) / d.sum(), 1, atol=1e-6)
    for axis in range(2):
        quotient = xy[:, axis] @ w @ xy[:, axis] / (d @ xy[:, axis] ** 2)
        assert abs(quotient - values[1 + axis]) < 0.02


def test_queries_stand_among_their_neighbours(spark):
    towns = ring(spark, 24)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id long, embedding array<double>")
    none = spark.createDataFrame([], "Town string, cluster int")
    marks = spark.createDataFrame([], "query_id long, pueblo string, rank int")
    places, users, _ = maps.entity_map_2d(towns, asked, none, marks, k=2)
    at = {r["Town"]: np.array([r["x"], r["y"]]) for r in places.collect()}
    user = {r["query_id"]: np.array([r["x"], r["y"]]) for r in users.collect()}
    near = [np.linalg.norm(user[1] - at[t]) for t in ("T000", "T001", "T023")]
    assert max(near) < min(np.linalg.norm(user[1] - at[t]) for t in ("T010", "T012", "T014")) and (user[2] == 0).all()


def test_registered_sizes_are_the_published_ones(spark):
    assert (queries.PER_ENTITY, queries.FIRST_N, queries.CORPUS, queries.EVALUATION, queries.BALANCED) == (100, 150, 8_000, 800, 200)
    assert (queries.STARTS, queries.TOPIC_COUNT, queries.K, queries.TOP) == (15, 19, 20, 5)
    found = queries.QUERIES["h2_assign_topics"](spark, SF).collect()
    sizes = np.bincount([r["topic"] for r in found if r["topic"] >= 0])
    assert len(found) == 500 and len(sizes) <= 19 and all(n >= max(5, 500 // 57) for n in sizes)
    assert {r["frame"] for r in queries.QUERIES["e17_entity_map"](spark, SF).collect()} == {"entity", "query", "mark"}
    assert [r["k"] for r in queries.QUERIES["f4_inertia_curve"](spark, SF).orderBy("k").collect()] == list(range(2, 10))
