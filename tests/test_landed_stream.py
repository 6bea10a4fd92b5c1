"""The files of a landed stream."""


def test_landed_stream_files_follow_the_bytes(spark):
    """A larger corpus lands in more files, still read in four micro-batches
    (before: four files, each one task or a few)."""
    from penmark.plans.queries import STREAM_BATCHES, _landed_stream

    stream = _landed_stream(spark, "/root/testdata/sf0.001", "test-src", ("doc_id", "text"), file_bytes=20_000)
    seen = []
    q = stream.writeStream.foreachBatch(lambda b, i: seen.append((b.count(), b.rdd.getNumPartitions(), len(b.inputFiles()))))
    q.trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == STREAM_BATCHES
    assert sum(n for n, *_ in seen) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
