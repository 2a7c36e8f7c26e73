"""Token ids in binary files.

Ids are replaced by their rank in frequency over the whole corpus, and ranks are written byte-aligned
with 1 to 4 bytes: the lengths of four ranks stand in one control byte, control bytes and data bytes in
two separate runs. Readers look up the four lengths of a control byte in a table, add them up to offsets
and gather all ranks of a block at once.

A written folder holds ``ranks`` (id by rank) and ``blocks``: rows (part, block, n_ids, first_id,
last_id, doc_ids, lengths, control, data). Parts follow one another by their ids, blocks by number; with
that, documents are in ascending order of id. A block ends after the document with which it reaches
``BLOCK_IDS``; no document is split.

Defined results: a null text is empty and has the end id alone; rows of a null id come first; equal ids
keep all their rows; an empty table gives an empty folder that reads as no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch, ship, written
from .backtrack_bpe import vocabulary
from .pieces import CutColumns
from .worker import held

BLOCK_IDS = 1 << 20
_NULL_ID = -(1 << 63)

#: For each control byte the byte lengths of its four values, and by length the bits that belong to a value.
LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], np.int64)
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    length = 1 + (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = length - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4, dtype=np.uint8) < length[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    offset = np.cumsum(length) - length
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    words = np.ndarray(max(0, len(padded) - 3), "<u4", padded, strides=(1,))  # four bytes from each place
    return words[offset] & _MASK[length]


_LINED = re.compile(r" \S+")
LINE_UNITS = 2000  # encoded at once


def _many(tokenizer, kind: str) -> Callable[[list[str]], list[bytes]]:
    """Ids of units. Those of a blank and what is no white space are encoded in lines, where the pattern
    cuts before every blank; how many bytes each token stands for tells where the ids of a unit end."""
    width, ids_by_token = np.dtype(kind).itemsize, tokenizer.get_vocab(with_added_tokens=False)
    n_bytes = np.zeros(1 + max(tokenizer.get_vocab().values(), default=0), np.int64)
    n_bytes[list(ids_by_token.values())] = list(map(len, ids_by_token))  # written with a character for each byte
    for k, token in tokenizer.get_added_tokens_decoder().items():
        n_bytes[k] = len(token.content.encode())

    def alone(units: list[str]) -> list[bytes]:
        return [np.array(e.ids, kind).tobytes() for e in tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def line(units: list[str]) -> list[bytes]:
        (found,) = tokenizer.encode_batch_fast(["".join(units)], add_special_tokens=False)
        ids = np.array(found.ids, kind)
        length = n_bytes[ids]
        ends, wanted = np.cumsum(length), np.cumsum([len(unit.encode()) for unit in units])
        if not len(ids) or not length.all() or ends[-1] != wanted[-1]:
            return alone(units)  # tokens do not tell their bytes
        stops = np.searchsorted(ends, wanted)
        if (ends[stops] != wanted).any():
            return alone(units)
        content, stops = ids.tobytes(), ((stops + 1) * width).tolist()
        return [content[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def make_many(units: list[str]) -> list[bytes]:
        fit = list(map(_LINED.fullmatch, units))
        lined = list(compress(units, fit))
        in_lines = chain.from_iterable(line(lined[a: a + LINE_UNITS]) for a in range(0, len(lined), LINE_UNITS))
        others = iter(alone([unit for unit, x in zip(units, fit, strict=True) if not x]))
        return [next(in_lines if x else others) for x in fit]

    return make_many


def _tokenizer(content: bytes, kind: str) -> CutColumns:
    def made() -> CutColumns:
        from tokenizers import Tokenizer

        return CutColumns(_many(Tokenizer.from_buffer(content), kind))

    return held(("token files", hashlib.sha256(content).digest(), kind), made)


def _encode(content, kind: str, end: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        cut = _tokenizer(content.value, kind)
        for batch in batches:
            at = 0
            for ids in cut.encode(batch.column("text")):
                ids = pc.binary_join_element_wise(ids, pa.scalar(end, pa.large_binary()), pa.scalar(b"", pa.large_binary())).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[at: at + len(ids)], ids], names=["doc_id", "ids"])
                at += len(ids)

    return run


def _frequencies(kind: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            joined = b"".join(batch.column("ids").to_pylist())
            total += np.bincount(np.frombuffer(joined, kind), minlength=size)
        (seen,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    return run


def _blocks(rank_of: np.ndarray, kind: str, block_ids: int):
    width = np.dtype(kind).itemsize

    def block(part: str, number: int, docs: list[tuple[int, bytes]]) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(x for _, x in docs), kind)
        control, data = pack(rank_of[ids])
        row = {
            "part": part, "block": number, "n_ids": len(ids), "control": control, "data": data,
            "first_id": docs[0][0], "last_id": docs[-1][0],
            "doc_ids": np.array([k for k, _ in docs], "<i8").tobytes(),
            "lengths": np.array([len(x) // width for _, x in docs], "<u4").tobytes(),
        }
        return pa.RecordBatch.from_pylist([row], _BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, docs, size = (None, 0), [], 0
        for batch in batches:
            for part, row, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "row", "doc_id", "ids")), strict=True):
                if docs and (part != at[0] or size >= block_ids):
                    yield block(*at, docs)
                    docs, size = [], 0
                if not docs:
                    at = (part, row)
                docs.append((doc_id, ids))
                size += len(ids) // width
        if docs:
            yield block(*at, docs)

    return run


_BLOCK = pa.schema(
    [("part", pa.string()), *((c, pa.int64()) for c in ("block", "n_ids", "first_id", "last_id"))]
    + [(c, pa.binary()) for c in ("doc_ids", "lengths", "control", "data")]
)
_BLOCK_DDL = (
    "part string, block long, n_ids long, first_id long, last_id long, "
    "doc_ids binary, lengths binary, control binary, data binary"
)


def _in_order(encoded: DataFrame) -> DataFrame:
    """Rows in parts that follow one another by ``doc_id``. The files of ``encoded`` are sorted; where
    no two of them overlap, each is a part and nothing moves. Otherwise the rows move to ranges."""
    named = encoded.select("*", F.col("_metadata.file_name").alias("part"), F.col("_metadata.row_index").alias("row"))
    before = Window.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    spans = named.groupBy("part").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))  # a row a file
    if not spans.select((F.max("hi").over(before) > F.col("lo")).alias("over")).where("over").take(1):
        return named
    return encoded.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(
        "*", F.spark_partition_id().cast("string").alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"),
    )


def write_token_files(
    docs: DataFrame, folder: str, path: str, vocabulary_size: int, end_id: int,
    text: str = "text", doc_id: str = "doc_id", block_ids: int = BLOCK_IDS,
) -> None:
    """Encode every whole text with the tokenizer file at ``path`` and write the ids to ``folder``."""
    spark = docs.sparkSession
    ship(spark)
    kind = "<u2" if vocabulary_size <= 1 << 16 else "<u4"
    content = spark.sparkContext.broadcast(vocabulary(path))
    source = docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.col(f"`{text}`").alias("text")
    )
    encoded = written(
        source.mapInArrow(_encode(content, kind, np.array([end_id], kind).tobytes()), "doc_id long, ids binary")
        .sortWithinPartitions("doc_id"),
        "token-ids", "zstd",
    )
    counts = (
        encoded.select("ids").mapInArrow(_frequencies(kind, vocabulary_size), "id long, n long")
        .groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").select("id").collect()
    )  # no more rows than the vocabulary has
    id_of = np.array([r["id"] for r in counts], np.uint32)
    rank_of = np.zeros(vocabulary_size, np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    spark.createDataFrame([(bytearray(id_of.astype("<u4").tobytes()),)], "ids binary").write.parquet(f"{folder}/ranks")
    _in_order(encoded).mapInArrow(_blocks(rank_of, kind, block_ids), _BLOCK_DDL).write.option(
        "compression", "zstd"
    ).parquet(f"{folder}/blocks")


def _read(id_of: np.ndarray, make_row, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = id_of[unpack(row["control"], row["data"], row["n_ids"])]
                stops = np.cumsum(np.frombuffer(row["lengths"], "<u4").astype(np.int64))
                starts = np.r_[0, stops[:-1]]
                made = [make_row(ids[a:b]) for a, b in zip(starts, stops, strict=True)]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n), pa.array(np.full(n, row["block"], np.int64)),
                        pa.array(np.frombuffer(row["doc_ids"], "<i8")), pa.array(starts), pa.array(stops - starts),
                        *([pa.array([m[k] for m in made]) for k in range(len(names))]),
                    ],
                    names=["part", "block", "doc_id", "place", "n_tokens", *names],
                )

    return run


def _rows(spark: SparkSession, folder: str, make_row, schema: str) -> DataFrame:
    ship(spark)
    (row,) = spark.read.parquet(f"{folder}/ranks").collect()
    id_of = np.frombuffer(bytes(row["ids"]), "<u4")
    blocks = spark.read.schema(_BLOCK_DDL).parquet(f"{folder}/blocks")
    before = Window.orderBy("lo", "hi", "part").rowsBetween(Window.unboundedPreceding, -1)
    spans = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min("first_id").alias("lo"), F.max("last_id").alias("hi"))
    parts = spans.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))  # a row a part
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("block_start"))
    starts = starts.join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("base"))
    names = [x.split()[0] for x in schema.split(", ")]
    rows = blocks.mapInArrow(
        _read(id_of, make_row, names), f"part string, block long, doc_id long, place long, n_tokens long, {schema}"
    )
    return rows.join(starts, ["part", "block"]).select(
        F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")).alias("doc_id"),
        (F.col("base") + F.col("place")).alias("start"), "n_tokens", *names,
    )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the folder."""
    return _rows(spark, folder, lambda ids: (ids.tolist(),), "ids array<long>")


def check_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the folder."""
    return _rows(spark, folder, lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),), "ids_crc32 long")


def token_file_digests(docs: DataFrame, path: str, vocabulary_size: int, end_id: int) -> DataFrame:
    folder = scratch(docs.sparkSession, "token-files")
    write_token_files(docs, folder, path, vocabulary_size, end_id)
    return check_token_files(docs.sparkSession, folder)
