"""Language identification by fusing evidence.

For every document and language the log-probabilities add up of: its text (byte trigrams of a model
fitted on a bounded labelled sample), the language that its markup declares, the suffix of its address,
and a prior of its host. How far declarations and suffixes are to be trusted, and what languages a host
holds, comes from grouped sums over all documents of what the texts alone say. Host priors are smoothed
along host, domain, all; a document's own share is taken out of its host's sums.

One more class, ``und``, has all trigrams equally likely and stands for what is no language; it is also
the answer for texts without a letter. Documents are rejected when the answer is ``und`` or its
probability is under ``LEAST``.

Defined results: null and letterless texts are ``und``; missing declarations, addresses and hosts
leave their terms out (the prior is then that of all); repeated rows get equal answers; an empty table
gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sampling import draw_at_least
from ..session import ship, written
from .worker import let_go

UNKNOWN = "und"
SAMPLE = 1_000  # labelled documents of each language that the text model is fitted on
BUCKETS = 1 << 15  # of trigrams
TEMPER = 0.4  # trigrams overlap, so they count for less than independent ones
PRIOR_WEIGHT = 20.0  # documents that a level's parent counts for
LEAST = 0.5
AT_ONCE = 1 << 15  # trigrams of a text that are looked up together
UNKNOWN_PRIOR = 1e-9
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def _trigrams(content: bytes) -> np.ndarray:
    b = np.frombuffer(b" " + content + b" ", np.uint8).astype(np.uint32)
    x = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((x * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def _content(text: str) -> bytes:
    """Lower case; digits and ASCII punctuation say nothing about the language and count as blanks."""
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            total += np.bincount(_trigrams(_content(text)), minlength=BUCKETS)
    yield pa.RecordBatch.from_pydict(
        {"lang": list(sums), "counts": [x.tobytes() for x in sums.values()]},
        pa.schema([("lang", pa.string()), ("counts", pa.binary())]),
    )


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
    return pa.table({"lang": table.column("lang")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def fit_text_model(docs: DataFrame, text: str, lang: str, doc_id: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and, for each bucket, the log-probability in each of them (and ``und`` at the end).

    The languages are those of all labelled rows; of each the ``sample`` documents of the smallest hashes of
    the id are read."""
    ship(docs.sparkSession)
    named = docs.select(
        F.xxhash64(F.col(f"`{doc_id}`")).alias("h"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")
    ).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    share = F.col("h").cast("double") / 2.0**64 + 0.5
    drawn = draw_at_least(named.select("lang", "h"), ["lang"], share, sample)  # little more than ``sample`` of each
    last = drawn.withColumn("nth", nth).where(F.col("nth") <= sample).groupBy("lang").agg(F.max("h").alias("last"))
    found = (
        named.join(F.broadcast(last), "lang").where("h <= last").select("lang", "text")  # a row for each language
        .mapInArrow(_counts, "lang string, counts binary")
        .groupBy("lang").applyInArrow(_added, "lang string, counts binary").orderBy("lang").collect()
    )  # a row for each language
    languages = [r["lang"] for r in found]
    columns = []
    for r in found:
        n = np.frombuffer(bytes(r["counts"]), np.int64) + 0.1
        columns.append(np.log(n / n.sum()))
    columns.append(np.full(BUCKETS, -np.log(BUCKETS)))
    return languages, np.array(columns, np.float32).T.copy()


def _likelihoods(model, at: list[str]):
    """Keeps the columns ``at`` and adds the tempered log-likelihoods and the languages' shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        table = model.value
        prior = np.log(np.r_[np.full(table.shape[1] - 1, 1.0), UNKNOWN_PRIOR])
        for batch in batches:
            logs = np.zeros((batch.num_rows, table.shape[1]))
            letters = []
            for k, text in enumerate(batch.column("text").to_pylist()):
                letters.append(bool(text) and _LETTER.search(text) is not None)
                if letters[-1]:
                    found = _trigrams(_content(text))
                    for a in range(0, len(found), AT_ONCE):
                        logs[k] += table[found[a:a + AT_ONCE]].sum(axis=0, dtype=np.float64) * TEMPER
            logs -= logs.max(axis=1, keepdims=True) if len(logs) else 0
            shares = np.exp(logs + prior)
            shares /= shares.sum(axis=1, keepdims=True)
            shares[~np.array(letters, bool)] = 0
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in at), pa.array(list(logs)), pa.array(list(shares)), pa.array(letters, pa.bool_())],
                names=[*at, "logs", "shares", "letters"],
            )

    return run


def _sums(n: int) -> list[Column]:
    return [F.sum(F.col("shares")[k]).alias(f"n{k}") for k in range(n)]


def _by_language(n: int, make) -> Column:
    return F.array(*[make(k) for k in range(n)])


def _evidence(scored: DataFrame, column: str, n: int) -> DataFrame:
    """(column, <column>_logs): log P(value | language), from all documents that have a value."""
    counts = scored.where(F.col(column).isNotNull()).groupBy(column).agg(*_sums(n))
    totals = counts.agg(*[F.sum(f"n{k}").alias(f"t{k}") for k in range(n)], F.count("*").alias("values"))
    return counts.crossJoin(F.broadcast(totals)).select(  # one row
        column,
        _by_language(n, lambda k: F.log((F.col(f"n{k}") + 0.5) / (F.col(f"t{k}") + F.col("values") * 0.5))).alias(f"{column}_logs"),
    )


def _host_priors(scored: DataFrame, n: int) -> DataFrame:
    """(host, h0.., host_n, parent): soft counts of the host, and the smoothed shares of its domain."""
    hosts = scored.where(F.col("host").isNotNull()).groupBy("host", "domain").agg(*_sums(n), F.count("*").alias("rows"))
    domains = hosts.groupBy("domain").agg(*[F.sum(f"n{k}").alias(f"d{k}") for k in range(n)], F.sum("rows").alias("domain_rows"))
    everything = scored.agg(*[F.sum(F.col("shares")[k]).alias(f"a{k}") for k in range(n)], F.count("*").alias("all_rows"))
    whole = lambda k: (F.coalesce(F.col(f"a{k}"), F.lit(0.0)) + 1.0 / n) / (F.col("all_rows") + 1.0)
    parents = domains.crossJoin(F.broadcast(everything)).select(  # one row
        "domain",
        _by_language(n, lambda k: (F.col(f"d{k}") + PRIOR_WEIGHT * whole(k)) / (F.col("domain_rows") + PRIOR_WEIGHT)).alias("parent"),
    )
    return hosts.join(parents, "domain").select(
        "host", F.col("rows").alias("host_rows"), _by_language(n, lambda k: F.col(f"n{k}")).alias("host_sums"), "parent"
    )


def identify(
    docs: DataFrame, text: Column, declared: Column, suffix: Column, host: Column, domain: Column,
    keep: list[str], languages: list[str], model: np.ndarray, late: DataFrame | None = None, on: str = "",
) -> DataFrame:
    """Columns ``keep`` with language, probability and kept. ``late`` may hold the columns that
    ``declared``, ``suffix``, ``host`` and ``domain`` need, by ``on``; it is joined after the texts are read."""
    spark = docs.sparkSession
    ship(spark)
    n = model.shape[1]
    sent = spark.sparkContext.broadcast(model)  # buckets times languages
    read = docs.select(*keep, text.alias("text")).mapInArrow(
        _likelihoods(sent, keep),
        ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
        + ", logs array<double>, shares array<double>, letters boolean",
    )
    read = read.join(late, on, "left") if late is not None else read
    scored = written(
        read.select(*keep, "logs", "shares", "letters", declared.alias("declared"), suffix.alias("suffix"), host.alias("host"), domain.alias("domain")),
        "language-scores",
    )
    all_prior = scored.agg(*[F.sum(F.col("shares")[k]).alias(f"a{k}") for k in range(n)], F.count("*").alias("all_rows"))
    all_prior = all_prior.select(
        _by_language(n, lambda k: (F.coalesce(F.col(f"a{k}"), F.lit(0.0)) + 1.0 / n) / (F.col("all_rows") + 1.0)).alias("everywhere")
    )
    fused = (
        scored.join(_evidence(scored, "declared", n), "declared", "left")
        .join(_evidence(scored, "suffix", n), "suffix", "left")
        .join(_host_priors(scored, n), "host", "left")
        .crossJoin(F.broadcast(all_prior))  # one row
    )
    prior = lambda k: F.when(
        F.col("host_rows").isNotNull(),
        (F.greatest(F.col("host_sums")[k] - F.col("shares")[k], F.lit(0.0)) + PRIOR_WEIGHT * F.col("parent")[k])
        / (F.col("host_rows") - 1 + PRIOR_WEIGHT),
    ).otherwise(F.col("everywhere")[k])
    score = lambda k: (
        F.col("logs")[k] + F.log(F.greatest(prior(k), F.lit(UNKNOWN_PRIOR if k == n - 1 else 1e-6)))
        + F.coalesce(F.col("declared_logs")[k], F.lit(0.0)) + F.coalesce(F.col("suffix_logs")[k], F.lit(0.0))
    )
    fused = fused.withColumn("scores", _by_language(n, score)).withColumn("top", F.array_max("scores"))
    total = F.aggregate(F.transform("scores", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    names = F.array(*[F.lit(x) for x in [*languages, UNKNOWN]])
    best = F.element_at(names, F.array_position("scores", F.col("top")).cast("int"))
    language = F.when(F.col("letters"), best).otherwise(F.lit(UNKNOWN))
    return fused.select(
        *keep, language.alias("language"), F.when(F.col("letters"), 1.0 / total).otherwise(1.0).alias("probability"), "declared", "host"
    ).withColumn("kept", (F.col("language") != UNKNOWN) & (F.col("probability") >= LEAST))


def page_evidence(pages: DataFrame) -> DataFrame:
    """(doc_id, page_lang, page_suffix, page_host): from the page of the smallest id whose address ends
    with the document's id. The suffix is the last label of the host and the first part of the path."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    found = pages.where(F.col("url").isNotNull()).select(
        "page_id",
        F.regexp_extract("url", r"/(\d{1,18})(?:\.[a-z]+)?(?:[?#].*)?$", 1).try_cast("long").alias("doc_id"),
        F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)).alias("page_lang"),
        F.concat_ws("/", F.substring_index(host, ".", -1), F.regexp_extract("url", r"^[a-zA-Z]+://[^/]+/([a-z]{2})/", 1)).alias("page_suffix"),
        host.alias("page_host"),
    ).where(F.col("doc_id").isNotNull())
    one = found.groupBy("doc_id").agg(F.min_by(F.struct("page_lang", "page_suffix", "page_host"), "page_id").alias("x"))
    return one.select("doc_id", *[F.nullif(F.col(f"x.{c}"), F.lit("")).alias(c) for c in ("page_lang", "page_suffix", "page_host")])


def document_languages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, key, language, probability, declared, host, kept) of every document; ``key`` is a hash of
    id and text. Documents without a page have their source for a host."""
    languages, model = fit_text_model(docs, "text", "lang", "doc_id")
    keyed = docs.select("doc_id", "text", "source", F.xxhash64("doc_id", "text").alias("key"))
    host = F.coalesce("page_host", "source")
    return identify(
        keyed, F.col("text"), F.col("page_lang"), F.col("page_suffix"), host, F.substring_index(host, ".", -3),
        ["doc_id", "source", "key"], languages, model, late=page_evidence(pages), on="doc_id",
    ).drop("source")


def accepted_documents(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    rejected = document_languages(docs, pages).where("not kept").select(F.col("key").alias("rejected_key")).distinct()
    return docs.join(rejected, F.xxhash64(docs["doc_id"], docs["text"]) == F.col("rejected_key"), "left_anti")
