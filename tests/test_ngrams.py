"""Counts of words and bigrams equal a plain count, and pass as few rows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from placelens.operators import tfidf

SCHEMA = "Town string, row_id long, full_text string"


def plain(rows) -> Counter:
    documents = defaultdict(list)
    for town, _, content in sorted(rows, key=lambda r: r[1]):
        documents[town] += (content or "").split()
    total = Counter()
    for town, words in documents.items():
        total.update((town, w) for w in words)
        total.update((town, f"{a} {b}") for a, b in zip(words, words[1:], strict=False))
    return total


def counted(spark, rows, **sizes) -> Counter:
    found = tfidf.ngram_counts(spark.createDataFrame(rows, SCHEMA).coalesce(1), stopwords=(), **sizes).collect()
    total = Counter({(r["Town"], r["term"]): r["n"] for r in found})
    assert len(total) == len(found)
    return total


def made(n: int, words: int):
    drawn = random.Random(3)
    vocabulary = ["".join(drawn.choices("abcdeñ", k=4)) for _ in range(words)]
    return [(f"T{k % 3}", k, " ".join(drawn.choices(vocabulary, k=drawn.randrange(0, 40)))) for k in range(n)]


def test_counts_in_small_parts_and_odd_rows(spark):
    rows = [*made(120, 30), (None, 500, "abc abd abc"), (None, 501, "abc"), ("T0", 502, None), ("T0", 503, "")]
    assert counted(spark, rows, at_once=50, bucket_bytes=64) == plain(rows)
    assert counted(spark, rows) == plain(rows)
    assert not counted(spark, [("T0", 1, None)]) and not counted(spark, [])


def test_a_row_that_comes_twice_has_one_place(spark):
    found = counted(spark, [("A", 1, "abc abd"), ("A", 1, "abc abd"), ("A", 2, "xyz")])
    assert found["A", "abc abd"] == 2 and found["A", "abd xyz"] == 1 and ("A", "abd abc") not in found


def test_counts_pass_as_one_row_a_slot(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(tfidf, "written", lambda df, name, keep=tfidf.written: tables.append(keep(df, name)) or tables[-1])
    rows = made(1500, 3000)
    found = counted(spark, rows)
    assert found == plain(rows) and len(found) > 30_000
    assert tables[0].count() <= len(rows) + 2**tfidf.SLOT_BITS
