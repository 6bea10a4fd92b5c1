"""Row operators, sinks and the display text."""

import os

from pyspark.sql import functions as F

from penmark.operators import report, scoring, text_ops
from penmark.plans import pipeline
from penmark.sources.model_io import Model


def _df(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_sentences_words_lines(spark):
    df = _df(spark, ["Hi there. Second one!\n\nThird?  ", "   "])
    s = [r.sentence for r in text_ops.sentences(df, ["doc_id"]).where("doc_id = 0").orderBy("pos").collect()]
    assert s == ["hi there", " second one", "third"]
    w = [r.word for r in text_ops.words(df, ["doc_id"]).where("doc_id = 0").orderBy("pos").collect()]
    assert w == ["hi", "there.", "second", "one!", "third?"]
    lines = text_ops.lines(df, ["doc_id"])
    assert [r.line for r in lines.where("doc_id = 0").orderBy("pos").collect()] == ["hi there. second one!", "third?"]
    assert lines.where("doc_id = 1").count() == 0


def test_grapheme_rows(spark):
    df = _df(spark, ["a👍🏽🇺🇸"])
    assert [r.grapheme for r in text_ops.grapheme_rows(df, ["doc_id"]).orderBy("pos").collect()] == ["a", "👍🏽", "🇺🇸"]


def test_phrase_hits(spark):
    df = _df(spark, ["The app is modern. Modern!", "we built the app as a team"])
    hits = {(r.family, r.phrase): r.n for r in text_ops.phrase_hits(df).collect()}
    assert hits[("buzzword", "modern")] == 2
    assert hits[("buzzword", "the app")] == 2
    assert hits[("backstory", "as a")] == 1


def test_markdown_breakdown(spark):
    df = _df(spark, ["# A\n\n**b** and *c* [l](u)"])
    r = text_ops.markdown_breakdown(df, ["doc_id"]).collect()[0]
    assert (r.md_atx, r.md_strong, r.md_emphasis, r.md_link, r.md_total) == (1, 1, 1, 1, 4)


def test_display_text(spark):
    df = _df(spark, ["It’s not just a modern app 🚀"])
    model = Model([[0.0] * 15, [10.0] * 15], 1)
    sc = scoring.score(df, model, keep=["doc_id"], with_metrics=True)
    flat = sc.select("doc_id", "chance_ai", "chance_human", "verdict", "metrics.*")
    text = scoring.display_text(scoring.nonzero_metrics(flat)).collect()[0].display
    assert text.startswith("Text is most likely ")
    assert "Chance:\n  AI    = " in text and "Non-zero metrics:\n" in text
    assert "  not_just_count: 1" in text


def test_write_scores_by_cluster(spark, tmpdir_fresh):
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(20)], "doc_id long, cluster int, chance_ai double")
    path = os.path.join(tmpdir_fresh, "scores")
    pipeline.write_scores(df, path, by_cluster=True)
    assert sorted(d for d in os.listdir(path) if d.startswith("cluster=")) == ["cluster=0", "cluster=1"]
    assert spark.read.parquet(path).count() == 20


def test_cluster_samples_bounded(spark):
    labelled = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, cluster int")
    texts = _df(spark, [f"text {i} modern" for i in range(50)])
    out = pipeline.cluster_samples(labelled, texts, n=3).collect()
    assert len(out) == 6
    assert all(r.summary.startswith("buzzword") for r in out)
    assert sorted({(r.cluster, r.sample_rank) for r in out}) == [(c, k) for c in (0, 1) for k in (1, 2, 3)]


def test_fit_pipeline_end_to_end(spark):
    from penmark.plans.marked import marked_documents

    docs = marked_documents(spark, "/root/testdata/sf0.001")
    model, labelled, rep = pipeline.fit_pipeline(docs, ["doc_id"], date="2025-08-09", runs=3)
    assert len(model.centroids) == 2 and model.ai_cluster in (0, 1)
    assert labelled.count() == docs.count()
    r = rep.collect()[0]
    assert r.date == "Aug 9, 2025"
    assert abs(float(r.human_pct) + float(r.ai_pct) - 100.0) < 0.011
    assert labelled.where(F.col("cluster").isNull()).count() == 0


def test_rows_without_cluster_are_reported(spark):
    lab = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2, "ab"[i % 2]) for i in range(50)], "doc_id long, cluster int, lang string")
    counts = report.cluster_counts(lab, 1)
    r = counts.collect()[0]
    assert (r.ai, r.human, r.total, r.n_null) == (20, 20, 40, 10)
    assert report.corpus_report(counts, "2025-08-09").collect()[0].n_null == 10
    by = {r.lang: (r.ai, r.human, r.n_null) for r in report.report_by(lab, ["lang"], 1).collect()}
    assert by == {"a": (0, 20, 5), "b": (20, 0, 5)}


def test_naming_from_fit_pass_equals_separate_job(spark):
    from penmark.plans.marked import marked_documents

    res = pipeline.train(marked_documents(spark, "/root/testdata/sf0.001"), ["doc_id"], runs=3)
    ai, stats = pipeline.name_clusters(res.points, res.model.centroids)
    assert ai == res.model.ai_cluster
    for a, b in zip(stats, res.stats):
        assert a["n"] == b["n"] and abs(a["emoji_sum"] - b["emoji_sum"]) < 1e-9


def test_public_column_helpers(spark):
    from pyspark.sql import functions as F

    from penmark.functions.emoji import emoji_count
    from penmark.functions.features import with_features
    from penmark.functions.metrics import with_text_metrics
    from penmark.functions.normalize import t1, t2_from_t1
    from penmark.functions.phrases import phrase_count, phrase_count_custom
    from penmark.operators.kmeans import compact, seed_centres

    df = _df(spark, ["Modern 🚀 app\n\nby   the app ✨", "plain"])
    t = df.select("doc_id", t2_from_t1(t1(F.col("text"))).alias("t2"))
    out = {r.doc_id: r for r in t.select(
        "doc_id", emoji_count(F.col("t2")).alias("e"), phrase_count(F.col("t2"), "buzzword").alias("b"),
        phrase_count_custom(F.col("t2"), ["app", "the app"]).alias("c")).collect()}
    assert (out[0].e, out[0].b, out[0].c) == (2, 3, 2)  # modern, the app, ✨; "app" alone twice
    feats = with_features(with_text_metrics(df), keep=["doc_id"])
    assert feats.columns == ["doc_id"] + [f"f{i}" for i in range(15)]
    seeds = seed_centres(compact(feats.drop("doc_id")), 2, 3, 7)
    assert len(seeds) == 3 and all(len(s) == 2 and len(s[0]) == 15 for s in seeds)


def test_command_line(spark, tmpdir_fresh, capsys):
    from penmark.__main__ import main

    src = "/root/testdata/sf0.001/documents.parquet"
    model = os.path.join(tmpdir_fresh, "model")
    assert main(["train", src, model, "--report", "2025-08-09", "--runs", "2"]) == 0
    assert "ai_cluster=" in capsys.readouterr().out
    out = os.path.join(tmpdir_fresh, "scores")
    assert main(["score", src, model, out]) == 0
    assert spark.read.parquet(out).count() == spark.read.parquet(src).count()
