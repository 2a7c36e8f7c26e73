"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from placelens.llm import trie_pairs


def brute_counts(rows, min_length=7, noise=31):
    total = Counter()
    for key, text in rows:
        start = zlib.crc32(f"{'null' if key is None else key}:".encode())
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in word)
            h = zlib.crc32(word.encode(), start)
            if noise and h % noise == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= min_length:
                total[word] += 1
    return {word: n for word, n in total.items() if n >= 2}


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_forms(counts, factor=10):
    out = {}
    for word, n in counts.items():
        others = sorted((v for v in counts if near(word, v)), key=lambda v: (-counts[v], v))
        form = others[0] if others and counts[others[0]] >= factor * n else None
        out[word] = (form, n, len(others), counts[form] if form else None)
    for word in out:
        root = word
        while out[root][0]:
            root = out[root][0]
        out[word] = (out[word][0], root, *out[word][1:])
    return out


def as_dict(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def misspelt(rng, word):
    k, c = rng.randrange(len(word)), rng.choice("aeßÿ×À")
    return rng.choice([word[:k] + word[k + 1:], word[:k] + c + word[k:], word[:k] + c + word[k + 1:], word[:k] + word[k] + word[k:]])


def vocabulary(rng, size):
    words = ["".join(rng.choices("aabbcé", k=rng.randrange(7, 11))) for _ in range(size)]
    words += [misspelt(rng, w) for w in words for _ in range(2)] + ["a" * k for k in range(7, 12)] + ["b" * 3000, "b" * 2999, "b" * 1500 + "c" + "b" * 1499]
    return sorted(set(words))


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_forms_of_given_words(spark, parts):
    rng = random.Random(parts)
    counts = {w: rng.choice([1, 2, 9, 10, 20, 100, 2_000, 10**6]) for w in vocabulary(rng, 300)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small ranges are joined into one
    try:
        df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
        assert as_dict(trie_pairs.variant_forms(df)) == brute_forms(counts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_documents(spark):
    rng = random.Random(7)
    words = vocabulary(rng, 60)
    hot = "the " + words[3]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 300)))) for k in range(80)]
    rows += [(k, hot.upper()) for k in range(100, 180)] + [(None, hot), (None, None), (3, ""), (4, None), (5, "1 2 ... ")]
    rows += [rows[0], rows[0], (9, "x" * 200_000), (9, "x" * 200_000), (10, "Ünïcode-wörd ÿÿÿÿÿÿÿ÷× " * 30)]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(6)
    counts = brute_counts(rows)
    assert {r["word"]: r["n"] for r in trie_pairs.word_counts(df, noise=31).collect()} == counts
    assert as_dict(trie_pairs.variant_forms(trie_pairs.word_counts(df, noise=31))) == brute_forms(counts)


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert trie_pairs.variant_forms(trie_pairs.word_counts(empty)).count() == 0
    one = spark.createDataFrame([("anything", 3)], "word string, n long")
    assert as_dict(trie_pairs.variant_forms(one)) == {"anything": (None, "anything", 3, 0, None)}


@pytest.mark.parametrize("a, b, n", [("", "", 0), ("a", "", 0), ("ab", "ac", 1), ("x" * 600, "x" * 600, 600), ("x" * 300 + "y", "x" * 301, 300)])
def test_common_prefix(a, b, n):
    assert trie_pairs.common_prefix(a, b) == n
