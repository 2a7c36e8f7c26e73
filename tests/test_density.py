"""Density clusters against brute force and planted groups."""

from __future__ import annotations

import numpy as np
import pytest
from placelens.operators import density, topics
from placelens.session import ship

V = "array<double>"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def planted(rng, sizes, noise, wide=12, spread=0.04):
    centres = rng.standard_normal((len(sizes), wide))
    rows = [c / np.linalg.norm(c) + spread * rng.standard_normal(wide) for c, n in zip(centres, sizes, strict=True) for _ in range(n)]
    return np.array(rows + list(rng.standard_normal((noise, wide)))), [k for k, n in enumerate(sizes) for _ in range(n)] + [-1] * noise


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(k), v.tolist(), "w") for k, v in zip(ids, x, strict=True)], f"row_id long, embedding {V}, w string").repartition(4)


def brute_reach(x, neighbours):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    d = np.sqrt(np.maximum(0, 2 - 2 * np.round(u @ u.T, 12)))
    core = np.sort(d, axis=1)[:, min(neighbours, len(x) - 1)]
    return core, np.maximum(d, np.maximum(core[:, None], core))


def brute_tree(w):
    """Prim's tree; edges sorted by weight, then rows."""
    n, inside, out = len(w), [0], []
    left = set(range(1, n))
    while left:
        best = min((w[a, b], min(a, b), max(a, b), b) for a in inside for b in left)
        out.append(best[:3])
        inside.append(best[3])
        left.remove(best[3])
    return sorted(out)


def test_tree_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, _ = planted(rng, [30, 25, 15], 30)
    x[7] = x[8] = x[9]
    monkeypatch.setattr(density, "GRID", {"left_block": 16, "right_block": 40})
    table = density.core_distances(frame(spark, x, [5 * k for k in range(len(x))]).select("row_id", "embedding"), 4)
    core, w = brute_reach(x, 4)
    got = {r["row_id"]: r["core"] for r in table.collect()}
    assert all(abs(got[5 * k] - c) < 1e-6 for k, c in enumerate(core))
    ids, edges = density.spanning_tree(table)
    want = brute_tree(w)
    assert ids.tolist() == [5 * k for k in range(len(x))]
    assert np.allclose(edges[:, 0], [e[0] for e in want], atol=1e-6) and len(edges) == len(x) - 1


def test_planted_groups_of_500(spark):
    rng = np.random.default_rng(2)
    x, truth = planted(rng, [150, 120, 90, 60], 80)
    got = {r["row_id"]: r["cluster"] for r in density.density_clusters(frame(spark, x), 30, 10, 8).collect()}
    assert len(got) == 500 and set(got.values()) == {-1, 0, 1, 2, 3}
    for k in range(4):  # the largest group first
        found = [got[i] for i, t in enumerate(truth) if t == k]
        assert found.count(k) >= 0.9 * len(found)
    noise = [got[i] for i, t in enumerate(truth) if t == -1]
    assert noise.count(-1) >= 0.6 * len(noise)  # rows on the rim of a cluster fall out of it late and belong to it


def test_cut_to_fewer_clusters_and_numbering(spark):
    rng = np.random.default_rng(3)
    x, _ = planted(rng, [60, 50, 40, 30], 0)
    for most in (1, 2, 3, 4):
        labels = [r["cluster"] for r in density.density_clusters(frame(spark, x), 12, most).collect()]
        sizes = np.bincount([c for c in labels if c >= 0])
        assert 1 <= len(sizes) <= most and sorted(sizes, reverse=True) == list(sizes) and min(sizes) >= 12


def condensed_by_levels(edges, n, minimum):
    """Sizes of groups of at least ``minimum`` that splits of two such groups make, from components at each level."""
    found = set()
    for k in range(len(edges)):
        label = density._components(n, [(int(a), int(b)) for _, a, b in edges[:k]])
        a, b = (frozenset(np.flatnonzero(label == label[int(x)]).tolist()) for x in edges[k][1:])
        if min(len(a), len(b)) >= minimum:
            found |= {a, b}
    return found


def test_condensed_tree_equals_components_at_each_level():
    rng = np.random.default_rng(4)
    x, _ = planted(rng, [25, 20, 15], 15)
    edges = np.array(brute_tree(brute_reach(x, 3)[1]))
    clusters = density.condensed_tree(len(x), edges, 6)

    def rows(k):
        return frozenset(clusters[k].rows).union(*(rows(c) for c in clusters[k].children))

    assert {rows(k) for k in range(1, len(clusters))} == condensed_by_levels(edges, len(x), 6)
    assert rows(0) == frozenset(range(len(x)))
    chosen = density.stable_clusters(clusters, 100)
    assert all(rows(a).isdisjoint(rows(b)) for a in chosen for b in chosen if a < b)


def test_few_rows(spark):
    for x in (np.zeros((0, 3)), np.ones((1, 3)), np.ones((4, 3)), np.ones((12, 3))):
        found = density.density_clusters(frame(spark, x), 5, 3).collect()
        assert len(found) == len(x) and {r["cluster"] for r in found} <= {-1, 0}


def test_too_many_rows(spark, monkeypatch):
    monkeypatch.setattr(density, "MOST_ROWS", 3)
    with pytest.raises(ValueError):
        density.density_clusters(frame(spark, np.ones((4, 3))), 5, 3)


def test_topics_have_outliers_and_a_least_size(spark):
    rng = np.random.default_rng(5)
    x, truth = planted(rng, [40, 40, 30], 40)
    found = topics.assign_topics(frame(spark, x), n_topics=4, neighbours=6)
    assert found.columns == ["row_id", "embedding", "w", "topic"]
    labels = [r["topic"] for r in found.collect()]
    sizes = np.bincount([t for t in labels if t >= 0])
    assert len(labels) == len(x) and -1 in labels and len(sizes) == 3 and min(sizes) >= max(5, len(x) // 12)
