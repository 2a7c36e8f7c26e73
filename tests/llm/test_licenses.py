"""License scans: planted notices, clean texts, odd rows."""

from __future__ import annotations

import random
import time

import pytest
from placelens.llm import license_scan


def test_alignment_is_a_common_subsequence():
    x, y = "a b c d e f c".split(), "z b c e f q".split()
    found = license_scan.align(x, y)
    assert all(x[a] == y[b] for a, b in found) and found == sorted(found)
    assert [y[b] for _, b in found] == ["b", "c", "e", "f"]
    assert license_scan._increasing([(0, 3), (1, 1), (2, 2), (3, 0), (4, 4)]) == [(1, 1), (2, 2), (4, 4)]


def test_planted_notices(spark):
    gpl = license_scan.TEMPLATES["GPL-3.0"]
    rows = [(1, "x y " * 50 + gpl + " z" * 9, 0), (2, gpl.upper().replace(" ", "\n"), 0), (3, "this work is licensed to nobody " * 30, 0),
            (4, None, 0), (5, "", 0), (None, gpl, 0), (6, "the " * 50_000, 0), (7, "This work is now licensed under the GNU General Public License version 3", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license int").repartition(3)
    found = license_scan.license_notices(df).where("license = 'GPL-3.0'").collect()
    assert sorted(((r["doc_id"], r["coverage"]) for r in found), key=repr) == [(1, 1.0), (2, 1.0), (7, 1.0), (None, 1.0)]
    assert {r["doc_id"]: (r["start_word"], r["end_word"]) for r in found}[1] == (100, 112)
    assert license_scan.license_notices(df.limit(0)).count() == 0


CUT = {name: license_scan.words(t) for name, t in license_scan.TEMPLATES.items()}


def found(text):
    return license_scan.notices(license_scan.words(text), CUT, license_scan.COVERAGE)


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_every_template_is_found_once_with_its_license(name):
    text = "one two three. " + license_scan.TEMPLATES[name] + " four five."
    assert found(text) == [(name.split("#")[0], 1.0, 3, 3 + len(CUT[name]))]


@pytest.mark.parametrize(("line", "license"), [
    ("Released under the MIT License.", "MIT"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("All rights reserved.", "ARR"),
])
@pytest.mark.parametrize("times", [1, 2, 5])
def test_repeated_notices_are_all_found(line, license, times):
    got = found("x y z " * 20 + (line + "\n") * times + "x y z " * 20 + line + " x y" * 30)
    n = len(license_scan.words(line))
    assert [(g[0], g[1], g[2]) for g in got] == [(license, 1.0, 60 + n * k) for k in range(times)] + [(license, 1.0, 120 + n * times)]


def test_changed_whole_texts_are_aligned():
    for name in ("MIT#text", "Apache-2.0#text"):
        w = list(CUT[name])
        for k in range(7, len(w), 12):
            w[k] = f"changed{k}"
        got = found(" ".join(["start", *w, "middle", *w, "end"]))
        assert [g[0] for g in got] == [name.split("#")[0]] * 2 and all(0.85 < g[1] < 1 for g in got)
    assert found("Licensed under the Foo License. Permission is granted to nobody under version 3.") == []


def brute(text, template):
    """Longest common subsequence by the plain table."""
    row = [0] * (len(template) + 1)
    for x in text:
        before, row = row, [0]
        for k, y in enumerate(template):
            row.append(before[k] + 1 if x == y else max(before[k + 1], row[k]))
    return row[-1]


def test_bounds_are_never_below_an_alignment():
    r = random.Random(3)
    for _ in range(200):
        text, template = ([r.choice("abcdef") for _ in range(r.randint(4, 40))] for _ in range(2))
        need = 0.5 * len(template)
        bounds = license_scan._Bounds(text, 0, len(text), template, set(template), need)
        for at, word in enumerate(text):
            for place in (k for k, w in enumerate(template) if w == word):
                a, b = max(0, at - 2 * len(template)), at + 2 * len(template)
                exact = brute(text[a:at], template[:place]) + 1 + brute(text[at + 1:b], template[place + 1:])
                assert bounds.pairs(at, place) >= (exact if exact >= need else 0)
                pairs = license_scan._around(text, template, at, place, a, min(b, len(text)))
                assert len(pairs) <= exact


def test_whole_texts_changed_and_shuffled_take_little_time():
    r, gpl = random.Random(1), CUT["GPL-3.0#text"]
    changed = [w if r.random() > 0.15 else r.choice(gpl) for w in gpl]
    shuffled = r.sample(gpl, len(gpl))
    by_sentence = [w for s in sorted(license_scan.TEMPLATES["GPL-3.0#text"].split(".")) for w in license_scan.words(s)]
    for text, licenses in ((gpl, ["GPL-3.0"]), (changed, ["GPL-3.0"]), (shuffled, []), (by_sentence, []), (gpl * 3, ["GPL-3.0"] * 3)):
        start = time.process_time()
        got = license_scan.notices(text, CUT, license_scan.COVERAGE)
        assert [g[0] for g in got if g[2] + 100 < g[3]] == licenses
        assert time.process_time() - start < 10  # about half a second; over 45 without the bounds
