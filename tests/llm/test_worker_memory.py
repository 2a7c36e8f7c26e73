"""What Python workers hold between tasks, and how many bytes they get at a time."""

import corpus_pipeline
import pyarrow as pa
from placelens.llm import grace_dedup, jaccard_join, language_evidence, latent_decontamination, worker
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


class Sent:
    value = None


def test_tables_of_another_operator_go():
    kept = worker.held("a", list)
    assert worker.held("a", list) is kept
    worker.held("b", list)
    assert list(worker._HELD) == ["b"]
    for run in (
        grace_dedup._local_classes, grace_dedup._grace(pa.schema([]), 1, True), language_evidence._counts, jaccard_join._sizes(5),
        jaccard_join._tokens(5, 4), latent_decontamination._frequencies(Sent()), latent_decontamination._matches(Sent()),
        latent_decontamination._without(Sent(), 0),
    ):
        worker.held("b", list)
        list(run(iter([])))
        assert not worker._HELD


def test_stages_hand_over_bounded_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    spark.conf.unset(LIMIT)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("long text "), 1000).alias("text"))
    try:
        corpus_pipeline.STAGES[1][1](spark, docs, SF)
        found = docs.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r["rows"] for r in found) == 3000 and max(r["bytes"] for r in found) < 6 << 20
        spark.conf.set(LIMIT, "1000000")
        corpus_pipeline.STAGES[1][1](spark, docs, SF)
        assert spark.conf.get(LIMIT) == "1000000"  # what the user sets holds
    finally:
        spark.conf.unset(LIMIT)
