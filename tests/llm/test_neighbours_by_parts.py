"""Learned partitions against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from placelens.llm import learned_partitions as parts
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, class int, `part.x` string"


def brute(rows, k, every):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and usable(v, 8)]
    out = {}
    for n, (q, x) in enumerate(good):
        if q % every == 0:
            found = sorted((-float((x * y).sum()), i) for m, (i, y) in enumerate(good) if m != n)
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def usable(v, wide):
    return v is not None and len(v) == wide and all(c is not None and np.isfinite(c) for c in v) and any(v)


def clusters(rng, n, wide=8, many=12):
    centres = rng.standard_normal((many, wide))
    x = centres[rng.integers(many, size=n)] + 0.25 * rng.standard_normal((n, wide))
    return x.astype(np.float32)


def answers(df, k, every):
    out = {}
    for r in sorted(parts.nearest_neighbours(df, F.col("vec_id") % every == 0, k).collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def test_one_part_is_exact(spark, monkeypatch):
    monkeypatch.setattr(parts, "PARTS_PER_ROOT", 0.0)
    rng = np.random.default_rng(1)
    x = clusters(rng, 300)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(1_000 + k, x[3].tolist()) for k in range(150)] + [(2_000 + k, (2 * x[5]).tolist()) for k in range(4)]
    zero = [0.0] * 8
    rows += [(10_000, None), (None, x[1].tolist()), (10_005, zero), (10_010, [1.0] * 7), (10_015, [float("nan")] + zero[1:]),
             (10_020, [float("inf")] + zero[1:]), (10_025, [None] + [1.0] * 7), (10_030, []), (10_035, [-0.0] * 8)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    want, got = brute(rows, 20, 5), answers(df, 20, 5)
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [i for i, _ in found] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in found], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_few_and_no_rows(spark):
    assert answers(spark.createDataFrame([], SCHEMA), 20, 5) == {}
    assert answers(spark.createDataFrame([(0, [1.0, 2.0], 1, "")], SCHEMA), 20, 5) == {}
    assert answers(spark.createDataFrame([(0, [1.0, 2.0], 1, ""), (7, [0.5, 0.0], 1, "")], SCHEMA), 20, 5) == {0: [(7, 0.5)]}


@pytest.mark.parametrize("hot", [False, True])
def test_recall(spark, monkeypatch, hot):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(parts, "PARTS_PER_ROOT", 0.35)
    monkeypatch.setattr(parts, "PILOT", 200)
    monkeypatch.setattr(parts, "BLOCK", 64)
    monkeypatch.setattr(parts, "QUERY_BLOCK", 16)
    rows = [(k, v.tolist()) for k, v in enumerate(clusters(rng, 2_400))]
    if hot:
        rows += [(10_000 + k, rows[7][1]) for k in range(1_200)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    classes = parts.vector_classes(df, 21, "embedding", "vec_id")
    assert classes.count() == 2_400 and classes.agg(F.max(F.size("ids"))).first()[0] == (21 if hot else 1)
    want, got = brute(rows, 20, 20), answers(df, 20, 20)
    assert got.keys() == want.keys() and all(len(found) == 20 for found in got.values())
    hits = sum(len({i for i, _ in found} & {i for i, _ in want[q]}) for q, found in got.items())
    assert hits >= 0.9 * 20 * len(want)
    for found in got.values():
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and len({i for i, _ in found}) == 20


def test_graph_parts_and_router():
    rng = np.random.default_rng(3)
    x = clusters(rng, 1_200, many=8).astype(np.float64)
    graph = parts.neighbour_graph(x, 10)
    part = parts.balanced_parts(graph, 8, rng)
    sizes = np.bincount(part, minlength=8)
    assert sizes.min() >= 148 and sizes.max() <= 152
    cut = (part[graph] != part[:, None]).mean()
    assert cut < 0.5 * (rng.permutation(part)[graph] != part[:, None]).mean()
    router = parts.Router.fit(x[:1_000], part[:1_000], parts.neighbour_graph(x[:1_000], 10), 8, rng)
    held_out = np.argsort(-router.logits(x[1_000:]), axis=1)
    assert (held_out[:, :3] == part[1_000:, None]).any(axis=1).mean() > 0.8


def test_equal_scores_do_not_depend_on_the_block():
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((50, 64)), rng.standard_normal((50, 64))
    assert (parts.exact_scores(a, b)[17:18] == parts.exact_scores(a[17:18], b[17:18])).all()
    q, c = parts.nearest(np.array([[1.0, 3.0, 3.0, 2.0, 3.0]]), 2)
    assert c.tolist() == [1, 2, 4]
