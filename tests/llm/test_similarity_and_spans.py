"""Similarity join and repeated spans against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from placelens.llm import components, jaccard_join, suffix_spans
from placelens.llm.words import pack48, unpack48, words_of

SCHEMA = "doc_id long, text string, class long, n int, key string, `anchor` int"


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def corpus(copies: int = 40, seed: int = 1) -> list[tuple]:
    """Near copies around the threshold, chains, passages in different documents, and odd texts."""
    rng = random.Random(seed)
    passage, base, texts = words(rng, 90), words(rng, 150), []
    for k in range(copies):
        w = list(base)
        for _ in range(k % 7):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    for _ in range(copies):
        texts.append(" ".join(words(rng, rng.randrange(30, 200)) + passage[: rng.randrange(40, 90)] + words(rng, 20)))
    chain = words(rng, 120)
    for k in range(8):
        texts.append("\t".join(chain[k * 9:] + [f"c{k}.{j}" for j in range(k * 9)]).upper())
    texts += [" ".join(words(rng, rng.randrange(1, 120))) for _ in range(60)]
    texts += [texts[3], texts[3].upper(), texts[3].replace(" ", "\n "), "", None, " \t", "a b", "A  b", "é É one", "b" * 50_000, "r " * 3000, "r " * 400]
    rng.shuffle(texts)
    rows = [(k * 3, t, k, 1, "k", None) for k, t in enumerate(texts)]
    return rows + [rows[5], rows[9], (None, texts[0], 0, 0, None, 0), (None, None, 0, 0, None, 0)]


def brute_components(rows):
    sets, parent = [], list(range(len(rows)))
    for r in rows:
        w = words_of(r[1], lower=True)
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return [(r[0], len(s), least.get(find(k)) if s else r[0]) for k, (r, s) in enumerate(zip(rows, sets, strict=True))]


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize(("rounds", "block"), [(0, 1024), (0, 5), (1, 5), (12, 1024)])
def test_components_equal_brute_force(spark, monkeypatch, rounds, block):
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert plain(jaccard_join.jaccard_components(df).collect()) == plain(brute_components(rows))


@pytest.mark.parametrize("rounds", [0, 12])
def test_short_near_copies_quoted_in_long_documents(spark, monkeypatch, rounds):
    """The quoted shingles stand in more sets than the first common one, though not in the prefix of a third."""
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", rounds)
    rng, texts = random.Random(4), []
    for k in range(30):
        common = [f"q{k}.{j}" for j in range(28)]
        for side in "ab":
            texts.append(" ".join([*common, *(f"{side}{k}.{j}" for j in range(4))]))
        quoted = common[: rng.choice([27, 25, 20])] if k % 3 else common[1:]
        texts.append(" ".join([*(f"c{k}.{j}" for j in range(200)), *quoted]))
    rows = [(k, t, k, 1, "k", None) for k, t in enumerate(texts)]
    want = brute_components(rows)
    assert sum(r[0] != r[2] for r in want) == 30
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert plain(jaccard_join.jaccard_components(df).collect()) == plain(want)


def test_one_row_of_each_component_stays(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    want = {(r[0], r[1]) for r, (i, n, c) in zip(rows, brute_components(rows), strict=True) if n == 0 or i == c or (i is None and c is None)}
    assert {(r[0], r[1]) for r in kept.collect()} == want


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert suffix_spans.repeated_spans_cut(empty).count() == 0
    nothing = spark.createDataFrame([(1, None, 0, 0, "", 0), (2, " ", 0, 0, "", 0)], SCHEMA)
    assert plain(jaccard_join.jaccard_components(nothing).collect()) == [(1, 0, 1), (2, 0, 2)]


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
@settings(max_examples=5, deadline=None)
def test_connected_components(spark, edges):
    parent = list(range(41))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}


@given(st.lists(st.integers(0, 2**48 - 1), max_size=20))
def test_six_byte_values(values):
    import numpy as np

    assert unpack48(pack48(np.array(values, np.uint64))).tolist() == values


def brute_spans(rows, length):
    last = (1 << 63) - 1
    first = {}
    texts = [(last if r[0] is None else r[0], words_of(r[1], lower=False)) for r in rows]
    for i, w in texts:
        for k in range(len(w) - length + 1):
            x = tuple(w[k:k + length])
            first[x] = min(first.get(x, i), i)
    out = []
    for r, (i, w) in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k:k + length])] < i:
                gone[k:k + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard_regions", [5000, 2])
def test_spans_equal_brute_force(spark, shard_regions):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = suffix_spans.repeated_spans_cut(df, shard_regions=shard_regions)
    assert plain(got.drop("kept").collect()) == plain(brute_spans(rows, 50))
    for r in got.where("kept is not null").collect():
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]


def test_short_spans_of_few_words(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choices("ab", k=rng.randrange(0, 40))), 0, 0, "", 0) for k in range(80)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = suffix_spans.repeated_spans_cut(df, length=7, gram=3)
    assert plain(got.drop("kept").collect()) == plain(brute_spans(rows, 7))


@given(st.lists(st.text("abc", max_size=12), max_size=6), st.text("abc", max_size=15))
@settings(max_examples=300, deadline=None)
def test_matching_statistics(references, query):
    automaton = suffix_spans.SuffixAutomaton()
    for reference in references:
        automaton.add(list(reference))
    want = [max(n for n in range(k + 2) if n == 0 or any(query[k + 1 - n:k + 1] in r for r in references)) for k in range(len(query))]
    assert automaton.matching_statistics(list(query)) == want
