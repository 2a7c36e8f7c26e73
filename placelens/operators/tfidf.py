"""TF-IDF with one document per entity, in long form."""

from __future__ import annotations

import zlib
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text
from ..functions.constants import STOPWORDS_ENTITY
from ..session import ship, written
from .entities import rank_entities_by_count

#: Terms are dealt to 2^11 slots by hash; a task counts so many words at a time; bytes of counts that a task adds up.
SLOT_BITS = 11
WORDS_AT_ONCE = 1 << 21
BUCKET_BYTES = 32 << 20


def boundary_pairs(tokens: DataFrame, entity: str = "Town") -> DataFrame:
    """(entity, last_word, next_word): the last word of a review and the first word of the
    entity's next review that has words.

    ``tokens`` has (entity, row_id, first_word, last_word), one narrow row per review with
    words. Rows move to ranges of ids of about equal size: inside a range the
    next review is found by a window over (entity, range), so a hot entity is spread over
    all ranges; between ranges it is found over one row per range, which bounds that window.
    """
    sliced = tokens.repartitionByRange("row_id").withColumn("_slice", F.spark_partition_id())
    inside = Window.partitionBy(entity, "_slice").orderBy("row_id")
    chained = sliced.select(
        entity,
        "_slice",
        "first_word",
        "last_word",
        F.row_number().over(inside).alias("_position"),
        F.lead("first_word").over(inside).alias("next_word"),
    )
    linked = chained.where(F.col("next_word").isNotNull())
    starts, stops = F.col("_position") == 1, F.col("next_word").isNull()
    ends = (
        chained.where(starts | stops)
        .groupBy(entity, "_slice")
        .agg(
            F.max(F.when(starts, F.col("first_word"))).alias("first_word"),
            F.max(F.when(stops, F.col("last_word"))).alias("last_word"),
        )
    )
    across = Window.partitionBy(entity).orderBy("_slice")
    joints = ends.select(
        entity, "last_word", F.lead("first_word").over(across).alias("next_word")
    ).where(F.col("next_word").isNotNull())
    return linked.select(entity, "last_word", "next_word").unionByName(joints)


def boundary_bigrams(tokens: DataFrame, entity: str = "Town") -> DataFrame:
    """The pairs of ``boundary_pairs`` as terms."""
    pairs = boundary_pairs(tokens, entity)
    return pairs.select(entity, F.concat_ws(" ", "last_word", "next_word").alias("term"))


def _unique(columns: list[np.ndarray], limits: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of whole numbers from 0 to under the limits, and how often each occurs."""
    most = 1
    for limit in limits:
        most *= limit
    if most >= 1 << 62:
        found, n = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
        return list(found.T), n
    key = columns[0]
    for column, limit in zip(columns[1:], limits[1:], strict=True):
        key = key * limit + column
    key = np.sort(key)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    n, key, found = np.diff(np.append(start, len(key))), key[start], []
    for limit in limits[:0:-1]:
        key, rest = np.divmod(key, limit)
        found.insert(0, rest)
    return [key, *found], n


def _schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("entity", kind), ("term", pa.string()), ("n", pa.int64())])


def _counted(entities: pa.Array, words: pa.ListArray, singles: bool) -> Iterator[tuple[int, bytes]]:
    """Counts of the terms of some reviews: (slot, table of entity, term and n) for each slot of terms."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    coded = words.flatten().dictionary_encode()
    known = coded.dictionary
    if not len(known):
        return
    word = coded.indices.to_numpy().astype(np.int64)
    named = entities.dictionary_encode()
    code = pc.fill_null(named.indices, len(named.dictionary)).to_numpy().astype(np.int64)
    of = np.repeat(code, lengths)
    review = np.repeat(np.arange(len(lengths)), lengths)
    pair = np.flatnonzero(review[1:] == review[:-1])
    owner, first, second = of[pair], word[pair], word[pair + 1]
    second = second + 1
    if singles:  # a single word has 0 for its second
        owner, first, second = (np.concatenate(x) for x in ((of, owner), (word, first), (np.zeros_like(word), second)))
    limits = [len(named.dictionary) + 1, len(known), len(known) + 1]
    (owner, first, second), n = _unique([owner, first, second], limits)
    crc = np.array([0, *(zlib.crc32(w.encode()) for w in known.to_pylist())], np.uint64)
    mixed = crc[first + 1] * np.uint64(0x9E3779B97F4A7C15) + crc[second] * np.uint64(0xC2B2AE3D27D4EB4F)
    slot = (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.uint16)
    order = np.argsort(slot, kind="stable")
    owner, first, second, n, slot = owner[order], first[order], second[order], n[order], slot[order]
    term = known.take(pa.array(first))
    both = pc.binary_join_element_wise(term, known.take(pa.array(second - 1, mask=second == 0)), " ")
    names = named.dictionary.take(pa.array(owner, mask=owner == len(named.dictionary)))
    rows = pa.RecordBatch.from_arrays([names, pc.coalesce(both, term), pa.array(n)], schema=_schema(entities.type))
    cuts = [0, *(np.flatnonzero(slot[1:] != slot[:-1]) + 1).tolist(), len(slot)]
    for k, end in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(slot[k]), rows.slice(k, end - k).serialize().to_pybytes()


def _entries(kind: pa.DataType, singles: bool, at_once: int):
    """Counted terms by slot and, with ``singles``, an entry for each review with its first and last word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entities, words = batch.column("entity"), batch.column("words")
            lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
            part = np.cumsum(lengths) // at_once  # whole reviews of about so many words
            for k in np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist() if len(part) else ():
                size = int(np.searchsorted(part, part[k], "right")) - k
                found = list(_counted(entities.slice(k, size), words.slice(k, size), singles))
                for i in range(0, len(found), 512):
                    some = found[i : i + 512]
                    nothing = [pa.nulls(len(some), t) for t in (kind, pa.int64(), pa.string(), pa.string())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[0] for x in some], pa.int32()), pa.array([x[1] for x in some], pa.binary()), *nothing], _NAMES
                    )
            if singles:
                some = batch.filter(pa.array(lengths > 0))
                lists = some.column("words")
                last = pc.subtract(pc.cumulative_sum(pc.list_value_length(lists)), 1)
                flat = lists.flatten()
                first = pc.add(pc.subtract(last, pc.list_value_length(lists)), 1)
                nothing = [pa.nulls(some.num_rows, t) for t in (pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [*nothing, some.column("entity"), some.column("row_id"), flat.take(first), flat.take(last)], _NAMES
                )

    return run


_NAMES = ["slot", "counts", "entity", "row_id", "first_word", "last_word"]


def _summed(entity: str, kind: pa.DataType):
    """All counts of the terms of one bucket added up."""

    def run(rows: pa.Table) -> pa.Table:
        schema = _schema(kind)
        counts = [pa.ipc.read_record_batch(x.as_buffer(), schema) for part in rows.column("counts").chunks for x in part]
        total = pa.Table.from_batches(counts, schema).group_by(["entity", "term"], use_threads=False).aggregate([("n", "sum")])
        return total.select(["entity", "term", "n_sum"]).rename_columns([entity, "term", "n"])

    return run


def ngram_counts(
    reviews: DataFrame,
    stopwords: Collection[str] = STOPWORDS_ENTITY,
    min_len: int = 3,
    entity: str = "Town",
    column: str = "full_text",
    at_once: int = WORDS_AT_ONCE,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Counts ``n`` of one- and two-word terms per entity.

    An entity's reviews form one document, so a bigram may join two reviews. Texts are cut
    into words once. Most bigrams are rare, so that rows of them would fill any table of a
    task: a task counts ``at_once`` words at a time, by sorting word numbers, and passes the
    counts on as one row for each slot (some bits of a hash of the term). These rows are
    written, with an entry of first and last word for each review, which the search for the
    next review reads. Neighbouring slots make buckets of about ``bucket_bytes``, and
    counts move once, to the task of their bucket.
    """
    spark = reviews.sparkSession
    ship(spark)
    kind = reviews.schema[entity].dataType
    name = kind.simpleString()
    schema = f"slot int, counts binary, entity {name}, row_id long, first_word string, last_word string"

    def entries(df: DataFrame, singles: bool) -> DataFrame:
        return df.mapInArrow(_entries(to_arrow_type(kind), singles, at_once), schema)

    cut = reviews.select(
        F.col(entity).alias("entity"), F.col("row_id").cast("long").alias("row_id"),
        text.tokenize(column, min_len, stopwords).alias("words"),
    )
    counted = written(entries(cut, True), "ngram-entries")
    edges = counted.where(F.col("slot").isNull()).select(
        F.col("entity").alias(entity), "row_id", "first_word", "last_word"
    ).distinct()  # a row that comes twice has one place in its entity's document
    joints = boundary_pairs(edges, entity).select(
        F.col(entity).alias("entity"), F.lit(None).cast("long").alias("row_id"), F.array("last_word", "next_word").alias("words")
    )
    within = counted.where(F.col("slot").isNotNull()).select("slot", "counts")
    size = within.agg(F.sum(F.octet_length("counts"))).first()[0] or 0
    bits = min(SLOT_BITS, (size // bucket_bytes).bit_length())
    rows = within.unionByName(entries(joints, False).select("slot", "counts"))
    bucket = F.shiftright("slot", SLOT_BITS - bits).alias("bucket")
    return rows.select(bucket, "counts").groupBy("bucket").applyInArrow(_summed(entity, to_arrow_type(kind)), f"`{entity}` {name}, term string, n long")


def vocabulary(counts: DataFrame, min_df: int = 2, max_features: int = 5000) -> DataFrame:
    """Terms in at least ``min_df`` entities, then the most frequent ones: (term, df, tf)."""
    return (
        counts.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf"))
        .where(F.col("df") >= min_df)
        .orderBy(F.desc("tf"), "term")
        .limit(max_features)
    )


def tfidf(
    counts: DataFrame,
    n_entities: Column,
    min_df: int = 2,
    max_features: int = 5000,
    entity: str = "Town",
) -> DataFrame:
    """``(1 + ln tf) * (ln((1 + n) / (1 + df)) + 1)``, scaled to length one per entity.

    ``n_entities`` counts all entities, with or without words. The vocabulary has at most
    ``max_features`` rows, which Spark sees from the limit and broadcasts.
    """
    terms = vocabulary(counts, min_df, max_features)
    idf = F.log((n_entities + 1.0) / (F.col("df") + 1.0)) + 1.0
    raw = counts.join(terms.select("term", idf.alias("_idf")), "term").select(
        entity, "term", F.col("n").alias("tf"), ((F.log("n") + 1.0) * F.col("_idf")).alias("_w")
    )
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(entity)))
    return raw.select(entity, "term", "tf", (F.col("_w") / length).alias("tfidf"))


def entity_count(reviews: DataFrame, entity: str = "Town") -> Column:
    """Number of entities as a scalar column."""
    return reviews.select(entity).distinct().agg(F.count(F.lit(1))).scalar()


def discriminative_terms(
    weights: DataFrame,
    cells: DataFrame,
    n_entities: Column,
    n_terms: int = 30,
    n_top: int = 20,
    entity: str = "Town",
) -> DataFrame:
    """Cells of the ``n_terms`` terms with the highest population variance over all
    entities (absent terms count as zero) for the ``n_top`` most reviewed entities.

    Equal variances go to the later term. The zero cells are read from a map of the chosen
    terms per entity.
    """
    mean = F.sum("tfidf") / n_entities
    variance = F.sum(F.col("tfidf") * F.col("tfidf")) / n_entities - mean * mean
    terms = (
        weights.groupBy("term")
        .agg(F.round(variance, 12).alias("variance"))
        .orderBy(F.desc("variance"), F.desc("term"))
        .limit(n_terms)
    )
    chosen = rank_entities_by_count(cells, n_top, entity)
    present = weights.join(terms.select("term"), "term").groupBy(entity).agg(
        F.map_from_entries(F.collect_list(F.struct("term", "tfidf"))).alias("_present")
    )
    grid = terms.agg(F.collect_list(F.struct("term", "variance"))).scalar()
    return (
        chosen.join(present, entity, "left")
        .select(entity, "_present", F.inline(grid))
        .select(
            entity,
            "term",
            "variance",
            F.coalesce(F.try_element_at("_present", F.col("term")), F.lit(0.0)).alias("tfidf"),
        )
    )


def top_terms_per_entity(
    weights: DataFrame,
    cells: DataFrame,
    stats: DataFrame,
    k: int = 8,
    n_top: int = 16,
    entity: str = "Town",
) -> DataFrame:
    """Strongest terms of the most reviewed entities, with region and size. Equal weights
    are in term order; an entity with fewer than ``k`` terms shows what it has."""
    chosen = rank_entities_by_count(cells, n_top, entity).select(entity)
    order = Window.partitionBy(entity).orderBy(F.desc(F.round("tfidf", 12)), "term")
    top = (
        weights.join(chosen, entity, "left_semi")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )
    return top.join(stats.select(entity, "Region", "n_reviews"), entity).select(
        entity, "Region", "n_reviews", "rank", "term", "tfidf"
    )
