"""Phrase counts and collocations against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from placelens.llm import collocations, count_automata
from placelens.llm.count_automata import CountAutomaton


def brute(rows, least, top=2_000, absorbed=80):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    f = {key: n for key, n in f.items() if n >= least}
    found = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or any(
            la == lang and len(q) > len(p) and 100 * n >= absorbed * a and any(q[i:i + len(p)] == p for i in range(len(q)))
            for (la, q), n in f.items()):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return {
        (lang, k + 1, p.decode(), -a, left, right, total[lang], -score)
        for lang, some in found.items() for k, (score, a, p, left, right) in enumerate(sorted(some)[:top])}


def texts(rng, n):
    words = ["a", "b", "B", "cé", "d\x01", "d", "\x00e", "ÿ", "#", "long" * 50]
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b", " "]) for _ in range(rng.randrange(60))))
    return out


@pytest.mark.parametrize("seed, places", [(1, 10**6), (2, 200), (3, 60)])
def test_against_brute_force(spark, monkeypatch, seed, places):
    rng = random.Random(seed)
    rows = [(rng.choice(["en", "en", "de", None, "e"]), t) for t in texts(rng, 150)]
    rows += [("en", None), ("en", ""), ("fr", " . "), (None, None), ("hot", "Strong tea, strong tea! strong tea"), ("en", "one word " * 3_000)]
    rows += [("hot", "strong tea leaves no doubt")] * 60 + [rows[0]] * 5
    monkeypatch.setattr(collocations, "RANGE_PLACES", places)
    df = spark.createDataFrame([(t, la, 1, "x") for la, t in rows], "text string, lang string, words int, `a.b` string").repartition(7)
    assert places == 10**6 or len(collocations.range_borders(df.where("text is not null").fillna("und", "lang").select("lang", "text"))) > 3
    found = collocations.collocations(df, least=5)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in found.collect()} == brute(rows, 5)
    assert {tuple(r) for r in collocations.collocations(df, least=5, top=3).collect()} == brute(rows, 5, 3)


def test_borders_of_sorted_ranges(spark):
    """Beginnings of a phrase that stand in an earlier range than it does."""
    rng = random.Random(4)
    rows = [("en", t) for t in texts(rng, 200)] + [("en", "x y z w x y z v " * 9)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 30)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small ranges are joined into one
    try:
        found = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=5)
        assert {tuple(r) for r in found.collect()} == brute(rows, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", "...")], "lang string, text string")).count() == 0


def automaton(rng, n, words):
    labels = np.array([rng.randrange(len(words) + 1) for _ in range(n)], np.uint32)
    return labels, CountAutomaton.build(count_automata.grams_at_every_place(labels), words)


def counts_of(labels, words):
    out, x = Counter(), [words[k - 1] if k else None for k in labels]
    for i in range(len(x)):
        for k in range(1, 5):
            if i + k <= len(x) and None not in x[i:i + k]:
                out[tuple(x[i:i + k])] += 1
    return out


def test_automata():
    rng = random.Random(5)
    parts, total = [], Counter()
    for words in ([b"a", b"b", b"c"], [b"b", b"bb", b"d"], [b"z"]):
        labels, a = automaton(rng, 400, words)
        assert dict(a.phrases(1)) == counts_of(labels, words) == dict(CountAutomaton.from_bytes(a.to_bytes()).phrases(1))
        assert dict(a.phrases(9)) == {p: n for p, n in counts_of(labels, words).items() if n >= 9}
        assert all(a.weight(p) == n for p, n in counts_of(labels, words).items())
        assert a.weight((b"no",)) == a.weight((b"z", b"a")) == 0
        total += counts_of(labels, words)
        parts.append(a)
    union = CountAutomaton.union(parts)
    assert dict(union.phrases(1)) == total and union.places() == sum(n for p, n in total.items() if len(p) == 1)
    assert dict(CountAutomaton.union([union]).phrases(1)) == total
    empty = CountAutomaton.build(count_automata.grams_at_every_place(np.zeros(3, np.uint32)), [])
    assert empty.phrases(1) == [] and dict(CountAutomaton.union([empty, union]).phrases(1)) == total


def test_equal_states_are_one():
    words = [b"a", b"b", b"x", b"y"]
    grams = count_automata.sorted_grams([np.array(c, np.uint32) for c in ([1, 2], [3, 3], [4, 4], [4, 4])])
    a = CountAutomaton.build(grams, words)
    assert [len(level[0]) - 1 for level in a.levels] == [1, 1, 1, 1]


def test_cut_at_any_phrase():
    rng = random.Random(6)
    words = [b"a", b"b", b"d", b"e"]
    labels, whole = automaton(rng, 500, words)
    grams = count_automata.grams_at_every_place(labels)
    rows = [tuple(words[c[i] - 1] for c in grams.columns if c[i]) for i in range(len(grams))]
    assert rows == sorted(rows)
    for phrase in [(), (b"a",), (b"b", b"c"), (b"c",), (b"z",), (b"a", b"b", b"d", b"e"), (b"e", b"e", b"e", b"f")]:
        assert count_automata.first_at_or_behind(grams, words, phrase) == sum(r < phrase for r in rows)
