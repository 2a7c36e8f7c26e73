"""Sets of frames: committed by their line, rebuilt for other inputs or parameters, never overwritten."""

from __future__ import annotations

from placelens.sources import artifacts
from pyspark.sql import functions as F


def test_other_parameters_or_rows_build_another_set(spark, tmp_path):
    path, built = str(tmp_path / "sets"), []
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")

    def get(n: int, df):
        def build():
            built.append(n)
            return {"first": df.limit(n), "all": df}

        return artifacts.load_or_build(spark, path, build, artifacts.fingerprint({"n": n}, df=df))

    assert get(1, rows)["first"].count() == 1 and get(1, rows)["all"].count() == 2
    assert built == [1]
    assert get(2, rows)["first"].count() == 2 and built == [1, 2]
    assert get(1, rows.repartition(3).orderBy(F.desc("id")))["first"].count() == 1 and built == [1, 2]
    get(1, rows.withColumn("text", F.coalesce("text", F.lit(""))))
    get(1, rows.unionByName(rows.limit(1)))
    assert built == [1, 2, 1, 1]


def test_a_set_that_is_read_is_not_overwritten(spark, tmp_path):
    path = str(tmp_path / "sets")
    artifacts.save_artifacts(path, rows=spark.range(5))
    old = artifacts.load_artifacts(spark, path)["rows"]
    artifacts.save_artifacts(path, rows=old.where("id < 2"))  # reads what it replaces
    assert old.count() == 5
    assert artifacts.load_artifacts(spark, path)["rows"].count() == 2


def test_a_set_without_its_line_is_not_loaded(spark, tmp_path):
    path = str(tmp_path / "sets")
    assert artifacts.load_artifacts(spark, path) is None
    spark.range(3).write.parquet(f"{path}/sets/half/rows")
    assert artifacts.load_artifacts(spark, path) is None
    artifacts.save_artifacts(path, set_name="x", rows=spark.range(4))
    assert artifacts.load_artifacts(spark, path) is None
    assert artifacts.load_artifacts(spark, path, "x")["rows"].count() == 4


def test_fingerprints_tell_nulls_and_columns_apart(spark):
    frames = [
        spark.createDataFrame([(None, "a")], "x string, y string"),
        spark.createDataFrame([("a", None)], "x string, y string"),
        spark.createDataFrame([("a", None)], "x string, z string"),
        spark.createDataFrame([], "x string, y string"),
    ]
    assert len({artifacts.fingerprint(df=df) for df in frames}) == len(frames)
