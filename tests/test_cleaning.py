"""Reading and cleaning: golden rows, files of several encodings and shapes, order of rows."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest
from placelens.functions import numeric, text
from placelens.operators import cleaning, counts, entities, statistics
from placelens.sources import reviews_csv
from pyspark.sql import functions as F

from conftest import ROOT

HEADER = "Title,Review,Town,Region,Type,Polarity\n"


def applied(spark, values, function):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["x"] for r in df.select("k", function("v").alias("x")).orderBy("k").collect()]


def test_encoding_repair(spark):
    given = ["PÃ¡tzcuaro", "Pátzcuaro", "日本", "Ã³ “x”", "😀", None, "ÃƒÂ³", "Ã\u0083Â³"]
    want = ["Pátzcuaro", "Pátzcuaro", "日本", "Ã³ “x”", "😀", "", "ÃƒÂ³", "Ã³"]
    assert applied(spark, given, text.fix_encoding) == want


def test_review_cleaning(spark):
    given = ["bueno...Más", "bueno....  mas \n", "…Más", "no ...Más fin", "...Más...Más", " a\tb\x7f "]
    want = ["bueno", "bueno.", "…Más", "no ...Más fin", "...Más", "a b"]
    assert applied(spark, given, text.clean_review) == want


def test_polarity(spark):
    given = ["4.7", "5.9", "0.9", "7", "n/a", "5d", "", None, " 5 ", "inf"]
    assert applied(spark, given, numeric.coerce_polarity) == [4, 5, 0, 7, None, None, None, None, 5, None]


def test_counts_of_words_and_sentences(spark):
    assert applied(spark, ["", "a.. b?! c"], text.n_words) == [0, 3]
    assert applied(spark, ["", "a.. b?! c"], text.n_sentences) == [0, 2]


def test_complaints(spark):
    assert applied(spark, ["El chocolate", "nada", "lento y caro"], text.classify_complaint) == ["Espera/colas", "Otro", "Servicio lento/malo"]


def test_files_of_two_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes((HEADER + 'Sí,"dos\nlíneas, ""x""",T,R,Hotel,5\n').encode())
    (tmp_path / "b.csv").write_bytes((HEADER + "Años,bien,T,R,Hotel,4\n").encode("latin-1"))
    rows = sorted(tuple(r) for r in reviews_csv.read_reviews_csv(spark, str(tmp_path)).collect())
    assert rows == [("Años", "bien", "T", "R", "Hotel", "4"), ("Sí", 'dos\nlíneas, "x"', "T", "R", "Hotel", "5")]


def test_rows_with_too_many_fields_stop_the_job(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "t,r,T,R,Hotel,5\nt,r,T,R,Hotel\n")
    assert reviews_csv.read_reviews_csv(spark, str(tmp_path)).count() == 2
    (tmp_path / "b.csv").write_text(HEADER + "t,r,T,R,Hotel,5,surplus\n")
    with pytest.raises(Exception, match="more fields"):
        reviews_csv.read_reviews_csv(spark, str(tmp_path)).collect()


def test_row_ids_follow_files_and_lines(spark, tmp_path):
    want = []
    for name, n in (("part-0", 1), ("part-1", 50), ("part-2", 5)):
        lines = [f"{name}.{k:02},r,T,R,Hotel,5" for k in range(n)]
        (tmp_path / f"{name}.csv").write_text(HEADER + "\n".join(lines) + "\n")
        want += [line.split(",")[0] for line in lines]
    numbered = cleaning.with_row_id(reviews_csv.read_reviews_csv(spark, str(tmp_path)))
    assert [r["Title"] for r in numbered.orderBy("row_id").collect()] == want
    assert numbered.select("row_id").distinct().count() == len(want)


def reviews(spark, rows):
    return spark.createDataFrame(rows, "row_id long, Town string, Region string, Type string, Polarity int")


def test_all_types_are_counted(spark):
    rows = [(k, "T", "R" if k % 3 else "S", f"type{k % 5}", 5) for k in range(30)]
    table = statistics.region_by_type(counts.review_cells(reviews(spark, rows)))
    got = {(r["Region"], r["Type"]): (r["n"], r["total"]) for r in table.collect()}
    assert len(got) == 10 and sum(n for n, _ in got.values()) == 30
    assert {t for (region, _), (_, t) in got.items() if region == "S"} == {10}


def test_statistics_of_one_row_and_of_four(spark):
    rows = [(0, "one", "R", "Hotel", 3)] + [(k, "four", "R", "Hotel", p) for k, p in enumerate([1, 2, 5, 5], 1)]
    got = {r["Town"]: r for r in entities.entity_stats(counts.review_cells(reviews(spark, rows)), decimals=None).collect()}
    assert got["one"]["std_polarity"] is None and got["one"]["n_reviews"] == 1
    assert got["four"]["median_polarity"] == 3.5 and abs(got["four"]["std_polarity"] - 2.0615528128) < 1e-9


def test_results_do_not_depend_on_partitions(spark):
    rows = [(k, f"T{k % 7}", f"R{k % 3}", f"type{k % 4}", 1 + k % 5) for k in range(300)]
    df = reviews(spark, rows)
    first, again = (
        sorted(map(tuple, entities.entity_stats(counts.review_cells(x)).collect())) for x in (df.coalesce(1), df.repartition(23))
    )
    assert first == again


def test_entity_index(spark):
    df = spark.range(500).select(F.format_string("T%03d", F.col("id") % 120).alias("Town"))
    got = sorted(map(tuple, entities.entity_index(df).collect()))
    assert got == [(f"T{k:03}", k) for k in range(120)]


def test_from_another_folder(tmp_path):
    """Workers find the package though neither the folder nor PYTHONPATH has it."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as entry
print("ROWS", entry.entry(spark).count(), len(entry.queries()) >= len(entry.oracle_sql()))
"""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300)
    assert "ROWS 2500 True" in out.stdout, out.stderr[-2000:]
