"""Exact deduplication as a Grace hash job.

Spark's exchange is the first partitioning; inside a task, records go into an open-addressing table
that compares complete content. When the table outgrows its memory, everything in it and everything
still to come goes to spill files by the next bits of the hash, and each file is treated alike.

A group of copies may be a third of all rows: each batch first keeps one row of every text, so the
exchange carries one row per text and batch, and the members find their group by an id of their batch.

Defined results: null counts as the empty text; texts are equal when identical after lower-casing
A-Z; of equal texts the row with the largest ``doc_id`` stays (null is smallest), of repeated rows
exactly one. An empty table gives an empty table; other columns, whatever their names, are carried.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..session import ship, written
from .worker import let_go

MEMORY_BYTES = 64 << 20
FANOUT = 16
_BITS = 4  # of the hash, for each level of spill files
_RECORD_BYTES = 400  # of Python objects around a text


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased: on bytes that is exactly what ``lower`` does."""
    return (text or "").encode().lower()


class ContentTable:
    """Open addressing with linear probing; equal means equal in complete content."""

    def __init__(self) -> None:
        self._slots = [-1] * 64
        self.records: list[list] = []
        self.size = 0

    def add(self, record: list, merge) -> None:
        """``record`` starts with its hash and its content; a record of equal content absorbs it."""
        if 2 * len(self.records) >= len(self._slots):
            self._grow()
        mask = len(self._slots) - 1
        at = record[0] & mask
        while (k := self._slots[at]) >= 0:
            other = self.records[k]
            if other[0] == record[0] and other[1] == record[1]:
                self.size += merge(other, record)
                return
            at = (at + 1) & mask
        self._slots[at] = len(self.records)
        self.records.append(record)
        self.size += _RECORD_BYTES + 2 * len(record[1])

    def _grow(self) -> None:
        self._slots = [-1] * (4 * len(self._slots))
        mask = len(self._slots) - 1
        for k, record in enumerate(self.records):
            at = record[0] & mask
            while self._slots[at] >= 0:
                at = (at + 1) & mask
            self._slots[at] = k


def _stored(path: str) -> Iterator[list]:
    with open(path, "rb") as file:
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def grace_groups(records: Iterable[list], merge, memory: int, depth: int = 0) -> Iterator[list]:
    """The merged records, one of each content, with at most about ``memory`` bytes held at a time.

    Past the last bits of the hash a file cannot be split further and is kept in one table.
    """
    table, files = ContentTable(), None
    shift = 60 - _BITS * depth
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        paths = [os.path.join(folder, f"{k}.spill") for k in range(FANOUT)]
        for record in records:
            if files is None:
                table.add(record, merge)
                if table.size > memory and shift >= 0:
                    files = [open(path, "wb") for path in paths]  # noqa: SIM115 - closed below
                    for kept in table.records:
                        pickle.dump(kept, files[kept[0] >> shift & FANOUT - 1])
                    table = ContentTable()
            else:
                pickle.dump(record, files[record[0] >> shift & FANOUT - 1])
        if files is None:
            yield from table.records
            return
        for file in files:
            file.close()
        for path in paths:
            yield from grace_groups(_stored(path), merge, memory, depth + 1)
            os.remove(path)


def _local_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch, one row of every text with its content, and for all others that row's id."""
    let_go()
    for batch in batches:
        rids, ids = batch.column("rid").to_pylist(), batch.column("id").to_pylist()
        table = ContentTable()
        for at, text in enumerate(batch.column("text").to_pylist()):
            content = normalised(text)
            table.add([xxhash.xxh3_64_intdigest(content), content, at, [at]], _join_local(ids))
        reps, counts, hashes = [0] * len(rids), [0] * len(rids), [0] * len(rids)
        for code, _, best, members in table.records:
            for at in members:
                reps[at] = rids[best]
            counts[best] = len(members)
            hashes[best] = code - (1 << 63)
        own = pa.array([at if counts[at] else None for at in range(len(rids))], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("rid"), batch.column("id"), pa.array(reps, pa.int64()),
                pa.array(counts, pa.int64()), pa.array(hashes, pa.int64()),
                batch.column("text").take(own), batch.column("row").take(own),
            ],
            names=["rid", "id", "rep", "copies", "code", "text", "row"],
        )


def _join_local(ids: list):
    def merge(kept: list, new: list) -> int:
        if _rank(ids[new[2]]) > _rank(ids[kept[2]]):
            kept[2] = new[2]
        kept[3] += new[3]
        return 0

    return merge


def _rank(doc_id) -> tuple:
    return (doc_id is not None, doc_id or 0)


def _join_groups(kept: list, new: list) -> int:
    """Record: hash, content, id, rid, copies, rids of the batches' rows, whole row."""
    if (_rank(new[2]), -new[3]) > (_rank(kept[2]), -kept[3]):
        kept[2], kept[3], kept[6] = new[2], new[3], new[6]
    kept[4] += new[4]
    kept[5] += new[5]
    return 8 * len(new[5])


def _grace(schema: pa.Schema, memory: int, rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()

        def records() -> Iterator[list]:
            for batch in batches:
                whole = batch.column("row")
                for at, (text, doc_id, rid, copies) in enumerate(
                    zip(*(batch.column(c).to_pylist() for c in ("text", "id", "rid", "copies")), strict=True)
                ):
                    content = normalised(text)
                    row = whole[at].as_py() if rows else None
                    yield [xxhash.xxh3_64_intdigest(content), content, doc_id, rid, copies, [rid], row]

        out, size = [], 0
        for _, content, doc_id, keep, copies, members, row in grace_groups(records(), _join_groups, memory):
            digest = hashlib.sha256(content).hexdigest()
            for rid in members:
                out.append(
                    {"rep": rid, "keep": keep, "keep_id": doc_id, "group_size": copies,
                     "text_sha256": digest, "row": row if rid == keep else None}
                )
                size += _RECORD_BYTES
            size += len(content) if rows else 0
            if size > 16 << 20:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _classes(docs: DataFrame, text: str, doc_id: str, memory: int, rows: bool) -> tuple[DataFrame, DataFrame]:
    """The rows' ids with those of their batches' rows; and what became of the batches' rows."""
    ship(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    source = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(f"`{doc_id}`").cast("long").alias("id"),
        F.col(f"`{text}`").alias("text"), (row if rows else F.struct(F.lit(1).alias("one"))).alias("row"),
    )
    kind = source.schema["row"].dataType
    local = written(
        source.mapInArrow(
            _local_classes,
            StructType(
                [StructField(c, LongType()) for c in ("rid", "id", "rep", "copies", "code")]
                + [StructField("text", StringType()), StructField("row", kind)]
            ),
        ),
        "grace",
    )
    schema = StructType(
        [StructField(c, LongType()) for c in ("rep", "keep", "keep_id", "group_size")]
        + [StructField("text_sha256", StringType()), StructField("row", kind)]
    )
    groups = (
        local.where("copies > 0").repartition("code")
        .select("rid", "id", "copies", "text", "row")
        .mapInArrow(_grace(to_arrow_schema(schema), memory, rows), schema)
    )
    return local.select("rid", "id", "rep"), groups


def duplicate_classes(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", memory: int = MEMORY_BYTES
) -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256)."""
    members, groups = _classes(docs, text, doc_id, memory, rows=False)
    return members.join(groups.drop("row"), "rep").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        (F.col("rid") == F.col("keep")).cast(BooleanType()).alias("kept"), "text_sha256",
    )


def drop_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", memory: int = MEMORY_BYTES
) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns of ``docs``."""
    _, groups = _classes(docs, text, doc_id, memory, rows=True)
    kept = groups.where("rep = keep").select("row.*")
    return kept.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in docs.schema.fields])
