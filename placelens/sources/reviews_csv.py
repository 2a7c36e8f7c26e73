"""Reviews from CSV with the encoding found out by reading."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import CSV_MISSING

MALFORMED = "_malformed"


def files_not_utf8(spark: SparkSession, path: str) -> list[str]:
    """Names of the files holding bytes that are no UTF-8.

    A line feed never occurs inside a multi-byte character, so lines can be checked one by
    one: the pass is splittable and has no size limit per file. Only file names come back.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    bad = lines.where(~F.is_valid_utf8("value")).select("file").distinct()
    return sorted(_named(row.file) for row in bad.collect())


def _named(file: str) -> str:
    """Listings and rows write "file:/" with one slash or three."""
    return re.sub("^file:/+", "file:///", file)


def read_reviews_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All columns as strings, named by the header; missing-value texts become null.

    Every file is read as UTF-8 if all of it is UTF-8, else as Latin-1, which takes any
    bytes, so no further encoding can be reached. Nothing is inferred from the values.
    ``multi_line`` keeps line breaks inside quotes and makes a file one task: give large
    data as many files, or set it to False where reviews have no line breaks.
    """
    latin1 = files_not_utf8(spark, path)
    everything = [_named(file) for file in spark.read.text(path).inputFiles()] if latin1 else []
    groups = {"UTF-8": sorted(set(everything) - set(latin1)), "ISO-8859-1": latin1}
    if not latin1:
        return _read(spark, [path], "UTF-8", multi_line)
    parts = [
        _read(spark, files, encoding, multi_line)
        for encoding, files in groups.items()
        if files
    ]
    return reduce(DataFrame.unionByName, parts)


def _read(spark: SparkSession, paths: list[str], encoding: str, multi_line: bool) -> DataFrame:
    """All fields as strings by the header's names. A row with more fields than the header
    stops the job; one with fewer is filled with nulls."""
    options = {"encoding": encoding, "multiLine": multi_line, "quote": '"', "escape": '"'}
    reader = spark.read.options(header=True, columnPruning=False, columnNameOfCorruptRecord=MALFORMED, **options)
    names = [f"`{c}` string" for c in spark.read.options(header=True, **options).csv(paths).columns]
    raw = reader.schema(", ".join([*names, f"`{MALFORMED}` string"])).csv(paths)
    fields = F.from_csv(MALFORMED, ", ".join([*names, "surplus string"]), {"quote": '"', "escape": '"'})
    # the message names a parsed field too: a scan must not ask for the malformed text alone
    row = F.concat_ws(" ... ", F.lit("a row has more fields than the header"), names[0].rsplit(" ", 1)[0], MALFORMED)
    error = F.raise_error(row)
    surplus = F.col(MALFORMED).isNotNull() & fields["surplus"].isNotNull()
    checked = raw.where(F.coalesce(F.when(surplus, error.cast("boolean")), F.lit(True))).drop(MALFORMED)
    missing = sorted(CSV_MISSING)
    return checked.select(
        *[F.when(~F.col(f"`{c}`").isin(missing), F.col(f"`{c}`")).alias(c) for c in checked.columns]
    )
