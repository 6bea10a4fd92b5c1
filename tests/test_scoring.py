"""Distances, shares, verdict, naming, listings (FIXTURES.md §5)."""

import pytest
from pyspark.sql import functions as F

from penmark.functions.features import linf_arrays
from penmark.functions.lexicon import METRIC_ORDER
from penmark.operators import report, scoring
from penmark.sources.model_io import Model

Z = [0.0] * 15


def _pt(*head):
    return list(head) + [0.0] * (15 - len(head))


def test_linf(spark):
    df = spark.createDataFrame([([0.0, 1.0], [9.0, 8.0]), ([0.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert [r.d for r in df.select(linf_arrays(F.col("a"), F.col("b")).alias("d")).collect()] == [9.0, 1.0]


def _score_distances(spark, d0, d1, ai=0):
    # a point at the origin, centres at distance d0 and d1 along f0
    df = spark.createDataFrame([(1, *Z)], "id int, " + ", ".join(f"f{i} double" for i in range(15)))
    return scoring.score_features(df, [_pt(d0), _pt(d1)], ai, ["id"]).collect()[0]


def test_shares_one_three(spark):
    r = _score_distances(spark, 1.0, 3.0)
    assert r.sims[0] == pytest.approx(2 / 3)
    assert r.chance_ai == pytest.approx(66.666667, abs=1e-6)
    assert r.chance_human == pytest.approx(33.333333, abs=1e-6)
    assert r.verdict == "AI"


def test_tie_is_exactly_half_and_ai(spark):
    r = _score_distances(spark, 2.0, 2.0)
    assert r.chance_ai == 50.0 and r.chance_human == 50.0
    assert r.verdict == "AI"


def test_predict_tie_goes_to_lower_cluster(spark):
    from penmark.operators.kmeans import predict

    df = spark.createDataFrame([(1, *Z)], "id int, " + ", ".join(f"f{i} double" for i in range(15)))
    assert predict(df, [_pt(2.0), _pt(-2.0)]).collect()[0].cluster == 0


def test_chances_sum_to_100(spark):
    rows = spark.createDataFrame([(i, float(i), *([0.0] * 14)) for i in range(20)],
                                 "id int, " + ", ".join(f"f{i} double" for i in range(15)))
    out = scoring.score_features(rows, [_pt(1.5), _pt(7.0)], 1, ["id"]).collect()
    assert all(abs(r.chance_ai + r.chance_human - 100.0) < 1e-9 for r in out)


def _stats(spark, rows):
    df = spark.createDataFrame(rows, "cluster int, emoji_rate double")
    return report.cluster_emoji_stats(df, 2)


def test_naming_rules(spark):
    st = _stats(spark, [(0, 1.0), (1, 0.5)])
    assert report.name_ai_cluster(st).collect()[0].ai_cluster == 0
    st = _stats(spark, [(0, 0.5), (1, 0.5)])
    assert report.name_ai_cluster(st).collect()[0].ai_cluster == 1
    st = _stats(spark, [(1, 0.2)])  # empty cluster 0
    rows = {r.cluster: r for r in st.collect()}
    assert rows[0].n == 0 and rows[0].emoji_mean == 0.0
    assert report.name_ai_cluster(st).collect()[0].ai_cluster == 1


def test_report_percentages_and_format(spark):
    counts = spark.createDataFrame([(2016, 37226)], "ai long, human long").select(
        "ai", "human", (F.col("ai") + F.col("human")).alias("total"),
        F.round(F.col("human") * 100.0 / (F.col("ai") + F.col("human")), 2).alias("human_pct"),
        F.round(F.col("ai") * 100.0 / (F.col("ai") + F.col("human")), 2).alias("ai_pct"),
    )
    r = report.corpus_report(counts, "2025-08-09").collect()[0]
    assert (r.date, r.human, r.ai, r.human_pct, r.ai_pct) == ("Aug 9, 2025", "37,226", "2,016", "94.86", "5.14")


def test_nonzero_listing_order_and_format(spark):
    vals = {m: 0.0 for m in METRIC_ORDER}
    vals.update(emoji_rate=1.25, labels=3.0, hashtags=3.0, buzzword_rate=0.125)
    df = spark.createDataFrame([tuple(vals[m] for m in METRIC_ORDER)], ", ".join(f"{m} double" for m in METRIC_ORDER))
    r = scoring.nonzero_metrics(df).collect()[0]
    # ties keep record order (labels before hashtags); toFixed(2) rounds 0.125 up
    assert r.nonzero_text.split("\n") == ["  labels: 3", "  hashtags: 3", "  emoji_rate: 1.25", "  buzzword_rate: 0.13"]


def test_summary_layout(spark):
    vals = {m: 0.0 for m in METRIC_ORDER}
    vals.update(emoji_rate=2.5, not_just_count=1.0, backstory_count=4.0)
    df = spark.createDataFrame([tuple(vals[m] for m in METRIC_ORDER)], ", ".join(f"{m} double" for m in METRIC_ORDER))
    r = scoring.metrics_summary(df).collect()[0]
    assert r.summary == "emoji     2.5\t\tnot_just  1\n          backstory 4"


def test_model_roundtrip(spark, tmpdir_fresh):
    import os

    from penmark.sources.model_io import load_model, save_model

    m = Model([_pt(1.0), _pt(2.0)], 1, 0.5, 3, True, 4)
    p = os.path.join(tmpdir_fresh, "model")
    save_model(m, spark, p)
    back = load_model(spark, p)
    assert back.centroids == m.centroids and back.ai_cluster == 1 and back.n_iter == 3
    with pytest.raises(Exception):
        save_model(m, spark, p)  # written once
    with pytest.raises(ValueError):
        Model([_pt(1.0)], 1).validate()


def test_predict_text(spark):
    from penmark import predict_text

    out = predict_text(spark, "It’s not just a modern app 🚀", Model([_pt(0.0), _pt(10.0)], 1))
    assert abs(out["chance_ai"] + out["chance_human"] - 100.0) < 1e-9
    assert out["metrics"]["not_just_count"] == 1.0 and out["verdict"] in ("AI", "Human")
