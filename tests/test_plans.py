"""Scale properties of the physical plans (executed, final adaptive plans)."""

from pyspark.sql import functions as F

from penmark.functions.metrics import with_text_metrics
from penmark.operators import kmeans, report, scoring
from penmark.plans import pipeline
from penmark.sources.corpus import table
from penmark.sources.model_io import Model

SF = "/root/testdata/sf0.001"


def _executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def _docs(spark):
    return table(spark, SF, "documents")


def test_metric_scan_reads_two_columns(spark):
    plan = _executed(with_text_metrics(_docs(spark).select("doc_id", "text"), "text").select("doc_id", "emoji_rate"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "HashAggregate" not in plan  # a projection: no aggregate, no join
    assert "Join" not in plan


def _feats(spark):
    docs = _docs(spark).select("doc_id", "lang", "text")
    return pipeline.feature_table(docs, ["doc_id", "lang"])


def test_compaction_is_map_side_combined(spark):
    plan = _executed(kmeans.compact(_feats(spark)))
    # partial aggregate below the exchange, final above it
    assert plan.index("Exchange hashpartitioning(f0") < plan.rindex("HashAggregate")


def test_lloyd_round_unnests_constant_centres_without_a_join(spark):
    pts = kmeans.compact(_feats(spark))
    loop = kmeans._Loop(pts, 2)
    try:
        df = spark.sql(loop.step_sql.format(centres=loop.centres_sql({0: [[0.0] * 15, [1.0] * 15]})))
        plan = _executed(df)
    finally:
        loop.close()
    assert "Generate explode" in plan and "Join" not in plan
    assert "partial_sum" in plan


def test_sample_limits_before_the_shuffle(spark):
    lab = kmeans.predict(_feats(spark), [[0.0] * 15, [1.0] * 15])
    plan = _executed(report.sample_per_cluster(lab, 5))
    assert "WindowGroupLimit" in plan and ", Partial" in plan


def test_report_by_is_partial(spark):
    lab = kmeans.predict(_feats(spark), [[0.0] * 15, [1.0] * 15])
    plan = _executed(report.report_by(lab, ["lang"], 1))
    assert "partial_sum" in plan


def test_cluster_samples_never_shuffle_text(spark):
    lab = kmeans.predict(_feats(spark), [[0.0] * 15, [1.0] * 15])
    plan = _executed(pipeline.cluster_samples(lab, _docs(spark), "doc_id", "text", 3))
    assert "BroadcastHashJoin" in plan
    for line in plan.split("\n"):
        if "Exchange hashpartitioning" in line:
            # the only hash exchange is the sample's (cluster) shuffle of narrow rows
            assert "cluster" in line


def test_no_exchange_between_scan_and_metrics(spark):
    docs = _docs(spark).select("doc_id", "text")
    assert "Exchange" not in _executed(with_text_metrics(docs))
    assert "Exchange" not in _executed(scoring.score(docs, Model([[0.0] * 15, [1.0] * 15], 1), keep=["doc_id"]))
    assert with_text_metrics(docs, rebalance=6).rdd.getNumPartitions() == 6


def test_defining_a_score_runs_no_job(spark):
    docs = _docs(spark).select("doc_id", "text")
    both = docs.join(docs.select("doc_id").distinct(), "doc_id")
    spark.sparkContext.setJobGroup("defining", "")
    try:
        scoring.score(both, Model([[0.0] * 15, [1.0] * 15], 1), keep=["doc_id"])
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("defining")
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_filters_on_metrics_stay_above_the_projection(spark):
    """A filter on a metric column must not be pushed into the metric chain
    (planning and generated code would explode); keys still push down."""
    import time

    docs = _docs(spark).select("doc_id", "text")
    t = time.time()
    df = with_text_metrics(docs).where((F.col("irregular_markdown") >= 0) & (F.col("emoji_rate") >= 0))
    assert df.count() == docs.count()
    assert time.time() - t < 60
    plan = _executed(with_text_metrics(docs).where(F.col("doc_id") < 10).select("doc_id"))
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id,10)]" in plan


def test_metric_subset_prunes_the_other_passes(spark):
    docs = _docs(spark).select("doc_id", "text")
    plan = _executed(with_text_metrics(docs, metrics=["emoji_rate"], keep_sentence_count=False))
    assert "_md_" not in plan and "_n_buzz" not in plan
    full = _executed(with_text_metrics(docs).select("doc_id", "emoji_rate"))
    assert "_md_" in full  # without the argument every metric is computed (the barrier's price)
