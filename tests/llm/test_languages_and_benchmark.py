"""Language evidence by held-out accuracy, decontamination by planted cases, the pipeline by its parts."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from placelens.llm import backtrack_bpe, catalog, language_evidence, latent_decontamination
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"
DOCS = "doc_id long, text string, lang string, source string, key string, logs int, host string"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    languages, model = language_evidence.fit_text_model(docs, "text", "lang", "doc_id", sample=200)
    rows = docs.select("doc_id", "text", "lang")
    none = F.lit(None).cast("string")
    found = language_evidence.identify(rows, F.col("text"), none, none, none, none, ["doc_id", "lang"], languages, model)
    share = found.agg(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0]
    assert share > 0.98
    assert found.where("not kept").count() == 0


def test_odd_documents(spark, tables):
    docs, pages, _ = tables
    english = docs.where("lang = 'en' and n_chars > 500").first()["text"]
    odd = [
        (10_001, None, None, None, "k", 1, "h"), (10_002, "", "en", "s", "k", 1, "h"), (10_003, "1234 -- 99", "en", "s", "k", 1, "h"),
        (10_004, english, None, None, None, None, None), (10_004, english, None, None, None, None, None), (None, english, "en", "s", "k", 1, "h"),
        (10_005, english * 200, "en", "s", "k", 1, "h"),
    ]
    extra = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(odd, DOCS), allowMissingColumns=True)
    found = [tuple(r) for r in language_evidence.document_languages(extra, pages).where("doc_id > 10000 or doc_id is null").select("doc_id", "language", "kept").collect()]
    want = [(10_001, "und", False), (10_002, "und", False), (10_003, "und", False), (10_004, "en", True), (10_004, "en", True), (None, "en", True), (10_005, "en", True)]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    kept = language_evidence.accepted_documents(extra, pages)
    assert kept.columns == extra.columns
    assert kept.count() == docs.count() + 4
    empty = extra.limit(0)
    assert language_evidence.document_languages(empty, pages).count() == 0
    assert language_evidence.document_languages(docs, pages.limit(0)).where("not kept").count() == 0


def test_evidence_decides_where_the_text_does_not(spark):
    """Equal texts of one word; hosts, declarations and suffixes differ."""
    rows = [(k, "aaa bbb ccc ddd", "en", "s") for k in range(60)] + [(100 + k, "xxx yyy zzz www", "fr", "s") for k in range(60)]
    rows += [(900, "q", None, "s"), (901, "q", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    pages = [(k, f"https://a.x.org/en/{k}", '<html lang="en">') for k in range(60)]
    pages += [(100 + k, f"https://b.y.net/fr/{100 + k}?q#t", "<HTML class=x LANG='fr'>") for k in range(60)]
    pages += [(900, "https://a.x.org/en/900.html", '<html lang="en">'), (901, "http://b.y.net:80/fr/901", "<html lang=fr>"), (902, None, None), (903, "junk", "")]
    found = language_evidence.document_languages(docs, spark.createDataFrame(pages, PAGES))
    assert {r["doc_id"]: r["language"] for r in found.where("doc_id >= 900").collect()} == {900: "en", 901: "fr"}


def shuffled_case(text):
    return text.upper().replace(".", " ;").replace(" ", "  ")


def reworded(text, rng, share):
    return " ".join(f"zq{rng.randrange(999)}" if rng.random() < share else w for w in text.split())


def test_planted_passages(spark, tables):
    docs, _, benchmark = tables
    rng = random.Random(4)
    items = benchmark.orderBy("item_id").collect()
    clean = [r["text"] for r in latent_decontamination.clean(docs, benchmark).select("text").collect()]
    long_clean = [t for t in clean if len(t) > 2000]
    rows, want = [], set()
    for k, item in enumerate(items):
        host = rng.choice(long_clean).split()
        at = rng.randrange(len(host))
        for j, form in enumerate((item["text"], shuffled_case(item["text"]), reworded(item["text"], rng, 0.12))):
            doc_id = 100_000 + 10 * k + j
            rows.append((doc_id, " ".join(host[:at] + [form] + host[at:]), 1, "x"))
            want.add((doc_id, item["item_id"]))
    rows += [(200_000 + k, t, 1, "x") for k, t in enumerate(clean)] + [(300_000, None, 1, "x"), (300_001, "", 1, "x"), (300_002, "word " * 90_000, 1, "x")]
    rows += [rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id long, `the.text` string").repartition(4)
    found = [(r["doc_id"], r["item_id"]) for r in latent_decontamination.contaminated(df, benchmark).collect()]
    assert set(found) == want and len(found) == len(want) + 1
    left = latent_decontamination.clean(df, benchmark)
    assert left.schema == df.schema
    assert {r["doc_id"] for r in left.collect()} == {r[0] for r in rows} - {d for d, _ in want}
    assert latent_decontamination.contaminated(df, benchmark.limit(0)).count() == 0
    assert latent_decontamination.contaminated(df.limit(0), benchmark).count() == 0
    odd = spark.createDataFrame([(1, None), (2, " ...")], "item_id long, text string")
    assert latent_decontamination.contaminated(df, odd).count() == 0


def test_recall_of_thousands_of_items_of_every_length(spark):
    """Items cut from documents, planted in others word by word or reworded with the answer kept, against
    ``verify`` on the whole document; with short ones and many that share their words."""
    rng = random.Random(11)
    docs = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text")
    texts = [t for t in (r["text"] for r in docs.collect()) if t and len(t.split()) > 70]
    lengths = [(3, 7), (8, 13), (14, 30), (31, 60)]
    items = []
    for k in range(2000):
        words = rng.choice(texts).split()
        n = rng.randint(*lengths[k % 4])
        at = rng.randrange(len(words) - n)
        items.append((k, " ".join(words[at:at + n])))
    index = latent_decontamination.build_index(docs, [{"item_id": k, "text": t} for k, t in items], "text")
    number = {x.item_id: j for j, x in enumerate(index.items)}
    caught: dict[tuple[str, int], list[bool]] = {}
    for k, text in rng.sample(items, 400):
        if k not in number:
            continue
        item = index.items[number[k]]
        words = text.split()
        body = max(0, len(words) - 5)
        kept = set(rng.sample(range(body), int(0.75 * body)))
        changed = " ".join(w if j in kept or j >= body else f"zq{rng.randrange(999)}" for j, w in enumerate(words))
        for kind, form in (("copy", text), ("reworded", changed)):
            host = rng.choice(texts).split()
            at = rng.randrange(len(host))
            document = latent_decontamination.terms(" ".join([*host[:at], form, *host[at:]]))
            n = len(item.words)
            around = len(latent_decontamination.terms(" ".join(host[:at])))
            if latent_decontamination.verify(item, document[max(0, around - 2):around + n + 2]):
                caught.setdefault((kind, k % 4), []).append(number[k] in latent_decontamination.search(index, document))
    for key, hits in caught.items():
        if len(hits) > 30:
            assert sum(hits) >= 0.97 * len(hits), (key, sum(hits), len(hits))
    hits = [hit for found in caught.values() for hit in found]
    assert all(caught["copy", 0]) and len(caught) >= 7 and sum(hits) >= 0.99 * len(hits)


def test_short_items_are_looked_up_exactly(spark):
    rng = random.Random(2)
    docs = [[rng.choice("abcde").encode() for _ in range(rng.randint(0, 40))] for _ in range(300)]
    frame = spark.createDataFrame([(k, b" ".join(d).decode()) for k, d in enumerate(docs)], "doc_id long, text string")
    items = [(k, " ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7)))) for k in range(60)] + [(60, "a"), (61, "a")]
    index = latent_decontamination.build_index(frame, [{"item_id": k, "text": t} for k, t in items], "text")
    for d in docs:
        want = {k for k, t in items if any(d[j:j + len(t.split())] == t.encode().split() for j in range(len(d)))}
        assert latent_decontamination.search(index, d).keys() == want


def test_long_texts_are_compared_in_chunks(spark):
    """A text of half a million words takes a bounded part of memory; items at its start, middle and end are found."""
    import tracemalloc

    rng = random.Random(6)
    items = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(20))) for k in range(200)]
    frame = spark.createDataFrame([(k, t) for k, t in items], "doc_id long, text string")
    index = latent_decontamination.build_index(frame, [{"item_id": k, "text": t} for k, t in items], "text")
    words = [f"w{rng.randrange(3000)}".encode() for _ in range(500_000)]
    for at, k in ((0, 3), (250_000, 4), (499_980, 5)):
        words[at:at + 20] = items[k][1].encode().split()
    tracemalloc.start()
    found = latent_decontamination.search(index, words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {3, 4, 5} <= found.keys() and peak < 250_000_000


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=14))
@settings(max_examples=300, deadline=None)
def test_longest_common_subsequence(x, y):
    rows = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            rows[i + 1][j + 1] = rows[i][j] + 1 if a == b else max(rows[i][j + 1], rows[i + 1][j])
    assert latent_decontamination.lcs_length(latent_decontamination._places(x), len(x), y) == rows[-1][-1]


def test_latent_space_is_the_singular_space(spark):
    import numpy as np

    texts = [f"a{k % 3} b{k % 5} c{k % 7} d{k}" for k in range(40)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    names = sorted({w for t in texts for w in latent_decontamination.terms(t)})
    term, idf = {t: k for k, t in enumerate(names)}, dict.fromkeys(names, 1.0)
    matrix = np.zeros((40, len(names)))
    for k, t in enumerate(texts):
        for w in latent_decontamination.terms(t):
            matrix[k, term[w]] += 1
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    vectors = latent_decontamination.latent_vectors(items, term, idf, rank=8, rounds=6)
    exact = np.linalg.svd(matrix)[1][:8]
    assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-8)
    assert np.allclose(np.linalg.norm(matrix @ vectors, axis=0), exact, rtol=1e-3)


def test_pipeline_stages_decide_what_they_should(spark):
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    keep = {}
    for i, t in rows:
        keep[(t or "").encode().lower()] = i
    left = [(i, t) for i, t in rows if keep[(t or "").encode().lower()] == i]
    from test_similarity_and_spans import brute_components

    left = [r for r, c in zip(left, brute_components(left), strict=True) if c[2] == r[0]]
    items = [b" " + b" ".join(latent_decontamination.terms(r["text"])) + b" " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [(i, t) for i, t in left if not any(x in b" " + b" ".join(latent_decontamination.terms(t)) + b" " for x in items)]
    assert set(got) == {i for i, _ in left}
    texts = dict(left)
    for i, r in got.items():
        encoder, cut = backtrack_bpe._encoder(
            backtrack_bpe.vocabulary(catalog.public_tokenizers.path("byte_bpe_50k.tiktoken")), catalog.public_tokenizers.PATTERN
        )
        assert r["n_tokens"] == len(r["ids"])
        assert b"".join(encoder.tokens[k] for k in r["ids"]).decode() == texts[i]


def test_stage_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1)).withColumn("key", F.lit("k"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_rare_languages_have_a_model(spark):
    russian = "это небольшой город на берегу реки"
    rows = [(k, "the quick brown fox and the old dog", "en") for k in range(2000)] + [(9_000 + k, f"{russian} {'да ' * k}", "ru") for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    languages, model = language_evidence.fit_text_model(docs, "text", "lang", "doc_id", sample=1)
    assert languages == ["en", "ru"] and model.shape[1] == 3
    at = language_evidence._trigrams(language_evidence._content(russian))
    assert model[at].sum(axis=0).argmax() == 1
    assert language_evidence.fit_text_model(docs.limit(0), "text", "lang", "doc_id")[0] == []
