"""Rounds over small tables leave the driver few tasks, however many shuffle partitions the session has."""

from __future__ import annotations

from placelens.llm import components as rounds
from placelens.llm import jaccard_join

PARTITIONS = 50


def tasks_of(spark, group, work):
    """What ``work`` returns, and the tasks of the stages that it ran."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(PARTITIONS))
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    told = spark.sparkContext.statusTracker()
    stages = {s for job in told.getJobIdsForGroup(group) for s in told.getJobInfo(job).stageIds}
    return out, sum(x.numCompletedTasks for x in map(told.getStageInfo, stages) if x)


def test_components_of_few_edges(spark, monkeypatch):
    monkeypatch.setattr(rounds, "LEAST_TASKS", 2)
    edges = [(10 * k + j, 10 * k + j + 1) for k in range(4) for j in range(5)]
    frame = spark.createDataFrame(edges, "a long, b long").coalesce(1)
    found, tasks = tasks_of(spark, "components", lambda: rounds.components(frame).collect())
    assert {(r["node"], r["label"]) for r in found} == {(10 * k + j, 10 * k) for k in range(4) for j in range(6)}
    assert tasks < 12 * PARTITIONS, tasks


def test_near_copies_of_few_documents(spark, monkeypatch):
    monkeypatch.setattr(rounds, "LEAST_TASKS", 2)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*words[: 40 + k], f"x{k}"])) for k in range(12)] + [(100, "alone among all these documents"), (101, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found, tasks = tasks_of(spark, "near copies", lambda: jaccard_join.jaccard_components(frame).collect())
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(k, 0) for k in range(12)} | {(100, 100), (101, 101)}
    assert tasks < 20 * PARTITIONS, tasks


def test_edges_of_many_shapes_end_in_stars(spark):
    edges = [(7, 3), (3, 9), (9, 7), (20, 21), (21, 20), (5, 5), (30, 31), (32, 31), (32, 33), (40, 41), (40, 41)]
    pairs, rows = rounds.stars(spark.createDataFrame(edges, "a long, b long"), len(edges))
    want = {(7, 3), (9, 3), (21, 20), (31, 30), (32, 30), (33, 30), (41, 40)}
    assert {(r["u"], r["v"]) for r in pairs.collect()} == want and rows == len(want) == pairs.count()
    pairs, rows = rounds.stars(spark.createDataFrame([(1, 1)], "a long, b long"), 1)
    assert (pairs.count(), rows) == (0, 0)
