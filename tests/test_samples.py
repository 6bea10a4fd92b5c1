"""Samples in groups and of streams: equal to the batch sample of the same rows."""

import hashlib
import os
import random

from penmark.operators import report, scoring
from penmark.sources.model_io import Model
from penmark.streaming import samples
from pyspark.sql import functions as F

MODEL = Model([[0.0] * 15, [10.0, 5.0] + [1.0] * 13], 1)


def _rows(n=600, seed=1):
    rng = random.Random(seed)
    # a third of the rows in one group; null groups and clusters; a key twice
    rows = [(i, rng.choice(["a", "a", "b", "c", None, "a"]), rng.choice([0, 1, 1, None])) for i in range(n)]
    return rows + [rows[0]]


def _picked(rows, n, seed=42):
    groups = {}
    for key, g, c in rows:
        if c is not None:
            groups.setdefault((g, c), []).append((hashlib.md5(f"{key}-{seed}".encode()).hexdigest(), key))
    return sorted((str(g), c, key, rank) for (g, c), v in groups.items() for rank, (_, key) in enumerate(sorted(v)[:n], 1))


def test_sample_by_is_the_smallest_keys(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, g string, cluster int").repartition(7)
    for n in (1, 4, 1000):
        got = sorted((str(r.g), r.cluster, r.doc_id, r.sample_rank) for r in report.sample_by(df, ["g"], n).collect())
        assert got == _picked(rows, n)


def test_report_with_samples(spark):
    rows = _rows() + [(9999, "only null", None)]
    df = spark.createDataFrame(rows, "doc_id long, g string, cluster int")
    got = {r.g: r for r in report.report_with_samples(df, ["g"], 1, 3).collect()}
    want = _picked(rows, 3)
    plain = {r.g: r for r in report.report_by(df, ["g"], 1).collect()}
    assert set(got) == set(plain) == {"a", "b", "c", None, "only null"}
    for g, r in got.items():
        for c, keys in ((1, r.ai_sample), (0, r.human_sample)):
            assert keys == [k for _, k in sorted((rank, k) for gg, cc, k, rank in want if (gg, cc) == (str(g), c))]
        assert (r.ai, r.human, r.n_null) == (plain[g].ai, plain[g].human, plain[g].n_null)
    assert (got["only null"].ai_pct, got["only null"].ai_sample) == (None, [])


def test_merged_batches_equal_the_whole(spark, tmpdir_fresh):
    rows = _rows(900, 3)
    df = spark.createDataFrame(rows, "doc_id long, g string, verdict int")
    path = os.path.join(tmpdir_fresh, "s")
    assert samples.read_samples(spark, path) is None

    def merge(b):
        part = df.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == b)
        samples.merge_sample(part, b, path, ["g"], 4, "doc_id", 42)

    for b in (0, 1, 2, 2, 3, 4, 4):  # batches 2 and 4 run again
        merge(b)
    got = sorted((str(r.g), r.verdict, r.doc_id, r.sample_rank) for r in samples.read_samples(spark, path).collect())
    assert got == _picked(rows, 4)
    assert len(samples._versions(spark, path)) == samples.KEPT
    # a version that a lost driver left half-written is not read
    os.makedirs(os.path.join(path, "version-5"))
    assert samples.read_samples(spark, path).count() == len(got)


def test_stream_sample_equals_batch_sample(spark, tmpdir_fresh):
    from penmark.plans.marked import marked_documents

    src, path = os.path.join(tmpdir_fresh, "src"), os.path.join(tmpdir_fresh, "samples")
    docs = marked_documents(spark, "/root/testdata/sf0.001", ("doc_id", "lang", "text"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 7 != 0, F.col("text")))

    def run():
        stream = spark.readStream.schema(docs.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)
        samples.start_sampling(stream, MODEL, path, ["lang"], 3).awaitTermination()

    docs.where("doc_id % 2 = 0").repartition(2).write.parquet(os.path.join(src, "one"))
    run()
    docs.where("doc_id % 2 = 1").repartition(2).write.parquet(os.path.join(src, "two"))
    run()  # a restart goes on from the sample so far
    landed = spark.read.option("recursiveFileLookup", "true").parquet(src)
    want = report.sample_by(scoring.score(landed, MODEL, keep=["doc_id", "lang"]).select("lang", "verdict", "doc_id"), ["lang"], 3, cluster="verdict")
    got = samples.read_samples(spark, path)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 0
