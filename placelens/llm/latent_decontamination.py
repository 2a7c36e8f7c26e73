"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages and weighted by TF-IDF, with document frequencies counted over the
whole corpus. A distributed randomised SVD of that matrix gives a latent space; every passage of every
document is projected into it and compared by cosine with all passages of the items (the stated query
set, in blocks). Candidates are then verified by the longest common subsequence of words: enough of the
item in order is a copy; a smaller share is a paraphrase, and counts only if the item's answer (its last
sentence) is there too.

The vocabulary of the latent space is that of the items, so its size follows the benchmark, not the
corpus; benchmarks of more than ``BLOCK_ITEMS`` are searched block by block. The rank grows with the number of
passages of the items, and passages of the documents are about twice as long as the items compared with them
(``WIDTHS``), so that a short item is not lost among the words around it.

Defined results: null and empty texts and items match nothing; items shorter than ``SHORT`` words must
occur word by word, and besides the latent search every occurrence of them is looked up exactly, by the item's rarest word
and what stands around it (cosine null where only the look-up found them); repeated rows are all found; empty tables give no matches; in ``clean`` the other
columns are carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import ship
from .worker import let_go

WIDTH, STRIDE = 64, 32  # words of a passage
WIDTHS = {16: 32}  # items up to so many words are compared with passages of so many, which overlap by half
RANK, MOST_RANK, OVERSAMPLE = 128, 384, 16  # the rank is an eighth of the passages, within these
CHUNK = 1024  # passages of a document compared at once
COMMON = 0.1  # terms in a larger share of the documents have no weight, unless the item has few others
COSINE = 0.2
COVERED = 0.25  # of a passage's weight along the item's direction
COPY, PARAPHRASE, ANSWER = 0.75, 0.5, 0.6  # shares of the item, or of its answer, in order
SHORT = 8
BLOCK_ITEMS = 10_000

_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Words in lower case, without ASCII punctuation."""
    return (text or "").lower().encode().translate(_PLAIN).split()


def lcs_length(item: dict[bytes, int], n: int, region: list[bytes]) -> int:
    """Longest common subsequence; ``item`` has for each word the bits of its places among ``n``."""
    free = (1 << n) - 1
    full = free
    for word in region:
        hits = item.get(word)
        if hits:
            taken = free & hits
            free = ((free + taken) | (free - taken)) & full
    return n - free.bit_count()


def _places(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for k, word in enumerate(words):
        out[word] = out.get(word, 0) | 1 << k
    return out


def _passages(n: int, width: int = WIDTH, stride: int = STRIDE) -> list[tuple[int, int]]:
    return [(a, min(n, a + width)) for a in range(0, max(1, n - width + stride), stride)] if n else []


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    places: dict[bytes, int]
    answer: dict[bytes, int]
    answer_words: int


@dataclass
class Queries:
    """Passages of items that are compared with passages of one width."""

    width: int
    item_of: np.ndarray  # of each passage
    unit: np.ndarray
    norms: np.ndarray


@dataclass
class Index:
    """What the workers need to search for one block of items."""

    items: list[Item]
    term: dict[bytes, int]
    vectors: np.ndarray  # weight times right singular vectors, a row for each term
    queries: list[Queries]
    # of short items: rarest word -> (its place, words of the item) -> the item's words -> numbers of the items
    short: dict[bytes, dict[tuple[int, int], dict[tuple[bytes, ...], list[int]]]]


def _item(item_id: int, text: str) -> Item:
    words = terms(text)
    sentences = [w for w in map(terms, re.split(r"[.!?\n]+", text)) if w]
    answer = sentences[-1] if sentences else []
    return Item(item_id, words, _places(words), _places(answer), len(answer))


def _frequencies(vocabulary) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        known = vocabulary.value
        total: Counter = Counter()
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column("text").to_pylist():
                total.update(known.intersection(terms(text)))
        found = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*found, None], pa.binary()), pa.array([*(total[t] for t in found), rows], pa.int64())], names=["term", "n"]
        )

    return run


def _weights(words: list[bytes], idf: dict[bytes, float]) -> dict[bytes, float]:
    counted = Counter(words)
    return {t: n * idf[t] for t, n in counted.items() if t in idf}


def _rows_of(content, idf_sent) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Unit TF-IDF rows of the passages in a batch of items: term numbers and weights."""
    term, idf = idf_sent.value
    for text in content:
        words = terms(text)
        for a, b in _passages(len(words)):
            row = _weights(words[a:b], idf)
            if row:
                x = np.array(list(row.values()))
                yield np.array([term[t] for t in row]), x / np.linalg.norm(x)


def _product(idf_sent, basis_sent, chunk: int, gram: bool):
    """Of the rows of a task: A^T (A B), in chunks of its rows; or, with ``gram``, (A B)^T (A B)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = basis_sent.value
        out = np.zeros((basis.shape[1] if gram else basis.shape[0], basis.shape[1]))
        for batch in batches:
            for at, x in _rows_of(batch.column("text").to_pylist(), idf_sent):
                y = x @ basis[at]
                if gram:
                    out += np.outer(y, y)
                else:
                    out[at] += np.outer(x, y)
        starts = list(range(0, len(out), chunk))
        yield pa.RecordBatch.from_arrays(
            [pa.array(starts, pa.int64()), pa.array([out[a: a + chunk].tobytes() for a in starts], pa.binary())], names=["start", "part"]
        )

    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("part"))
    return pa.table({"start": table.column("start")[:1], "part": pa.array([total.tobytes()], pa.binary())})


def _summed(items: DataFrame, product, columns: int) -> np.ndarray:
    """Sum over all tasks; as large as the vocabulary of the items times the rank."""
    parts = (
        items.select("text").mapInArrow(product, "start long, part binary")
        .groupBy("start").applyInArrow(_added, "start long, part binary").orderBy("start").collect()
    )
    return np.frombuffer(b"".join(bytes(r["part"]) for r in parts), np.float64).reshape(-1, columns)


def latent_vectors(items: DataFrame, term: dict[bytes, int], idf: dict[bytes, float], rank: int = RANK, rounds: int = 2) -> np.ndarray:
    """Right singular vectors (terms by rank) of the TF-IDF passages of ``items``, by randomised SVD."""
    context = items.sparkSession.sparkContext
    sent = context.broadcast((term, idf))
    width = min(len(term), rank + OVERSAMPLE)
    basis = np.random.default_rng(7).standard_normal((len(term), width))
    for _ in range(rounds):  # range finder with power iterations
        basis_sent = context.broadcast(basis)
        basis, _ = np.linalg.qr(_summed(items, _product(sent, basis_sent, 4096, gram=False), width))
        basis_sent.destroy()
        width = basis.shape[1]
    basis_sent = context.broadcast(basis)
    squares = _summed(items, _product(sent, basis_sent, 4096, gram=True), width)
    basis_sent.destroy()
    sent.destroy()
    values, turn = np.linalg.eigh(squares)
    order = [k for k in np.argsort(values)[::-1][:rank] if values[k] > 1e-9 * max(values.max(), 1e-300)]
    return basis @ turn[:, order]


def build_index(docs: DataFrame, rows: list, text: str) -> Index | None:
    """Latent space and queries of one block of items."""
    spark = docs.sparkSession
    items = [x for x in (_item(r["item_id"], r["text"] or "") for r in rows) if x.words]
    if not items:
        return None
    vocabulary = frozenset(w for x in items for w in x.words)
    sent = spark.sparkContext.broadcast(vocabulary)
    counted = (
        docs.select(F.col(f"`{text}`").alias("text"))
        .mapInArrow(_frequencies(sent), "term binary, n long")
        .groupBy("term").agg(F.sum("n").alias("n")).collect()
    )  # no more rows than the items have terms
    sent.destroy()
    found = {bytes(r["term"]) if r["term"] is not None else None: r["n"] for r in counted}
    total = found.pop(None, 0)
    weight = {t: float(np.log((total + 2) / (found.get(t, 0) + 1))) for t in vocabulary}
    rare = {t for t in vocabulary if found.get(t, 0) <= max(1, COMMON * total)}
    used = set(rare)
    for x in items:
        if len(rare.intersection(x.words)) < 5:
            used.update(x.words)
    idf = {t: weight[t] for t in sorted(used)}
    term = {t: k for k, t in enumerate(idf)}
    frame = spark.createDataFrame([(x.item_id, " ".join(w.decode() for w in x.words)) for x in items], "item_id long, text string")
    passages = sum(len(_passages(len(x.words))) for x in items)
    vectors = latent_vectors(frame, term, idf, min(MOST_RANK, max(RANK, passages // 8)))
    scaled = np.array(list(idf.values()))[:, None] * vectors
    of_width: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for k, x in enumerate(items):
        item_of, queries = of_width.setdefault(next((w for n, w in WIDTHS.items() if len(x.words) <= n), WIDTH), ([], []))
        for a, b in _passages(len(x.words)):
            at = [term[t] for t in x.words[a:b] if t in term]
            if at:
                item_of.append(k)
                queries.append(scaled[at].sum(axis=0))
    short: dict = {}
    for k, x in enumerate(items):
        if (n := len(x.words)) < SHORT:
            place = min(range(n), key=lambda j, x=x: (found.get(x.words[j], 0), j))
            short.setdefault(x.words[place], {}).setdefault((place, n), {}).setdefault(tuple(x.words), []).append(k)
    return Index(items, term, scaled.astype(np.float32), [_queries(w, *of_width[w], vectors.shape[1]) for w in sorted(of_width)], short)


def _queries(width: int, item_of: list[int], rows: list[np.ndarray], rank: int) -> Queries:
    matrix = np.array(rows).reshape(len(rows), rank)
    norms = np.linalg.norm(matrix, axis=1)
    real = norms > 1e-9
    unit = matrix[real] / norms[real, None]
    return Queries(width, np.array(item_of, np.int64)[real], unit.astype(np.float32), norms[real].astype(np.float32))


def _short_items(index: Index, words: list[bytes]) -> set[int]:
    """Numbers of the short items that occur word by word."""
    out: set[int] = set()
    anchors = index.short.keys() & set(words)
    if anchors:
        for at, word in enumerate(words):
            if word in anchors:
                for (place, n), known in index.short[word].items():
                    if at >= place:
                        out.update(known.get(tuple(words[at - place: at - place + n]), ()))
    return out


def _close(index: Index, queries: Queries, words: list[bytes], at: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(start of a passage, number of an item, cosine) of all candidates; ``at`` and ``numbers`` are the places of
    the words that are terms, and their terms. Works on ``CHUNK`` passages at a time."""
    starts = np.array([a for a, _ in _passages(len(words), queries.width, queries.width // 2)])
    lo, hi = np.searchsorted(at, starts), np.searchsorted(at, starts + queries.width)
    some = hi > lo
    starts, lo, hi = starts[some], lo[some], hi[some]
    for c in range(0, len(starts), CHUNK):
        first, last = lo[c: c + CHUNK], hi[c: c + CHUNK]
        sums = np.zeros((last[-1] - first[0] + 1, index.vectors.shape[1]))
        np.cumsum(index.vectors[numbers[first[0]: last[-1]]], axis=0, dtype=np.float64, out=sums[1:])
        latent = (sums[last - first[0]] - sums[first - first[0]]).astype(np.float32)
        norms = np.maximum(np.linalg.norm(latent, axis=1), 1e-9)
        along = latent @ queries.unit.T
        for p, q in zip(*np.nonzero((along >= COSINE * norms[:, None]) & (along >= COVERED * queries.norms)), strict=True):
            yield int(starts[c + p]), int(queries.item_of[q]), float(along[p, q] / norms[p])


def search(index: Index, words: list[bytes]) -> dict[int, tuple[float | None, float]]:
    """Items found in a document: number of the item to (cosine, share of it in order)."""
    best: dict[int, tuple[float | None, float]] = {k: (None, 1.0) for k in _short_items(index, words)}
    terms_at = list(map(index.term.get, words))
    at = np.array([k for k, x in enumerate(terms_at) if x is not None], np.int64)
    numbers = np.array([x for x in terms_at if x is not None], np.int64)
    for queries in index.queries if len(at) else ():
        for start, k, cosine in _close(index, queries, words, at, numbers):
            item = index.items[k]
            n = len(item.words)
            held = best.get(k, (None, 0.0))
            if held[1] == 1.0 and held[0] is not None or n < SHORT and not held[1]:
                continue
            share = verify(item, words[max(0, start - n): start + queries.width + n])
            if share and (share > held[1] or held[0] is None):
                best[k] = (cosine, share)
    return best


def verify(item: Item, region: list[bytes]) -> float:
    """Share of the item that the region holds in order, or 0 if that is no match."""
    n = len(item.words)
    if n < SHORT:
        return 1.0 if any(region[k: k + n] == item.words for k in range(len(region) - n + 1)) else 0.0
    share = lcs_length(item.places, n, region) / n
    if share >= COPY:
        return share
    if share >= PARAPHRASE and lcs_length(item.answer, item.answer_words, region) >= ANSWER * item.answer_words:
        return share
    return 0.0


def _matches(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        ready = index.value
        for batch in batches:
            rows = {"doc_id": [], "item_id": [], "cosine": [], "share": []}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for k, (cosine, share) in search(ready, terms(text)).items():
                    for c, x in zip(rows, (doc_id, ready.items[k].item_id, cosine, share), strict=True):
                        rows[c].append(x)
            yield pa.RecordBatch.from_pydict(
                rows, pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("share", pa.float64())])
            )

    return run


def _without(index, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        ready = index.value
        for batch in batches:
            yield batch.filter(pa.array([not search(ready, terms(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list]:
    """The items in blocks, each bounded; the stated query set."""
    rows = []
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id").toLocalIterator():
        rows.append(row)
        if len(rows) == BLOCK_ITEMS:
            yield rows
            rows = []
    if rows:
        yield rows


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, cosine, share): the items found in each document that holds any."""
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = spark.createDataFrame([], "doc_id long, item_id long, cosine double, share double")
    for rows in _blocks(benchmark):
        if (index := build_index(docs, rows, text)) is not None:
            found = found.unionByName(
                source.mapInArrow(_matches(spark.sparkContext.broadcast(index)), "doc_id long, item_id long, cosine double, share double")
            )
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    spark = docs.sparkSession
    ship(spark)
    # columns go by their place: their own names may hold dots or be equal
    plain = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema)])
    out = docs.toDF(*plain.names)
    for rows in _blocks(benchmark):
        if (index := build_index(docs, rows, text)) is not None:
            out = out.mapInArrow(_without(spark.sparkContext.broadcast(index), docs.columns.index(text)), plain)
    return out.toDF(*docs.columns)
