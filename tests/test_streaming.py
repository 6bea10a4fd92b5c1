"""Batch = stream for scoring (F6)."""

import os

from penmark.operators import scoring
from penmark.sources.model_io import Model
from penmark.streaming.score_stream import start_scoring


def test_stream_equals_batch(spark, tmpdir_fresh):
    from penmark.plans.marked import marked_documents

    docs = marked_documents(spark, "/root/testdata/sf0.001")
    src = os.path.join(tmpdir_fresh, "src")
    docs.repartition(3).write.parquet(src)
    model = Model([[0.0] * 15, [10.0, 5.0] + [1.0] * 13], 1)
    sink = os.path.join(tmpdir_fresh, "sink")
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = start_scoring(stream, model, sink, keep=["doc_id"], checkpoint=os.path.join(tmpdir_fresh, "ck"))
    q.awaitTermination()
    streamed = spark.read.parquet(sink)
    batch = scoring.score(spark.read.parquet(src), model, keep=["doc_id"])
    cols = ["doc_id", "chance_ai", "chance_human", "verdict"]
    assert streamed.count() == docs.count()
    assert streamed.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    assert batch.select(*cols).exceptAll(streamed.select(*cols)).count() == 0


def test_restart_from_checkpoint_is_exactly_once(spark, tmpdir_fresh):
    """A restarted query resumes from its checkpoint: files already scored are
    not scored again, new files are."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    src = os.path.join(tmpdir_fresh, "src")
    docs.where(F.col("doc_id") < 100).write.parquet(os.path.join(src, "part1"))
    model = Model([[0.0] * 15, [10.0, 5.0] + [1.0] * 13], 1)
    sink = os.path.join(tmpdir_fresh, "sink")
    ck = os.path.join(tmpdir_fresh, "ck")
    schema = docs.schema

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        start_scoring(stream, model, sink, keep=["doc_id"], checkpoint=ck).awaitTermination()

    run()
    first = spark.read.parquet(sink).count()
    docs.where(F.col("doc_id") >= 100).write.parquet(os.path.join(src, "part2"))
    run()
    out = spark.read.parquet(sink)
    assert first == docs.where(F.col("doc_id") < 100).count()
    assert out.count() == docs.count()
    assert out.select("doc_id").distinct().count() == docs.count()


def test_null_texts_are_counted_per_batch(spark, tmpdir_fresh):
    """Each micro-batch reports its rows without a verdict, and the batches add up to the sink."""
    from penmark.streaming.score_stream import batch_counts, sink_counts

    src, sink = os.path.join(tmpdir_fresh, "src"), os.path.join(tmpdir_fresh, "sink")
    schema = "doc_id long, text string"
    for i in range(3):
        rows = [(3 * i, "plain"), (3 * i + 1, None), (3 * i + 2, "🚀🚀🚀 – – –")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = start_scoring(stream, Model([[0.0] * 15, [50.0] * 15], 1), sink, keep=["doc_id"])
    q.awaitTermination()
    per = [c for c in map(batch_counts, q.recentProgress) if c]
    assert len(per) == 3 and all(c["total"] == 3 and c["n_null"] == 1 and c["ai"] + c["human"] == 2 for c in per)
    assert {k: sum(c[k] for c in per) for k in per[0]} == sink_counts(spark, sink)
