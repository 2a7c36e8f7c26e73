"""Short rounds take few tasks; sequences are sorted as single numbers, with the results of a plain count."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from placelens.llm import count_automata
from placelens.llm import components as rounds


def test_short_rounds_take_few_tasks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(rounds, "written", lambda df, name, keep=rounds.written: keep(seen.append(df) or df, name))
    monkeypatch.setattr(rounds, "LEAST_TASKS", 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = rounds.components(spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long"))
        assert {(r["node"], r["label"]) for r in found.collect()} == {(k, 0) for k in range(41)}
        assert len(seen) > 2 and all(df.rdd.getNumPartitions() <= 2 for df in seen[1:])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("most, n", [(2, 0), (4, 9), (300, 5000), (1 << 31, 500)])
def test_sorted_grams_are_a_plain_count(most, n):
    drawn = np.random.default_rng(5).integers(0, most, (4, n), dtype=np.uint32)
    grams = count_automata.sorted_grams(list(drawn))
    rows = list(zip(*(c.tolist() for c in grams.columns), strict=True))
    assert rows == sorted(rows) and dict(zip(rows, grams.counts.tolist(), strict=True)) == Counter(zip(*drawn.tolist(), strict=True))


def test_words_of_usual_numbers_are_sorted_once(monkeypatch):
    monkeypatch.setattr(np, "lexsort", None)
    drawn = np.random.default_rng(5).integers(0, 100_000, (4, 2000), dtype=np.uint32)
    assert len(count_automata.sorted_grams(list(drawn))) == 2000
