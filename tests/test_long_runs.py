"""Long runs and null texts (a repeated group must not overflow the stack)."""

import time

from metric_rows import metrics_of

from penmark.operators import kmeans, report, scoring


def test_long_runs_of_block_lines(spark):
    n = 100_000
    quote, indented, rule = "> q\n" * n, "a\n\n" + "    code\n" * n, "* " * n + "\n"
    rows = metrics_of(spark, [quote, indented, rule])
    assert all(r.irregular_markdown is not None for r in rows)


def test_null_features_have_no_cluster_and_no_verdict(spark):
    df = spark.createDataFrame([(1, *[None] * 15), (2, *[1.0] * 15)], "doc_id long, " + ", ".join(f"f{i} double" for i in range(15)))
    centres = [[0.0] * 15, [1.0] * 15]
    got = {r.doc_id: r for r in scoring.score_features(df, centres, 0, ["doc_id"]).collect()}
    assert (got[1].chance_ai, got[1].chance_human, got[1].verdict) == (None, None, None) and got[2].verdict == "Human"
    assert [r.c for r in df.orderBy("doc_id").select(kmeans.assign_expr(centres).alias("c")).collect()] == [None, 1]


def test_unclosed_links_and_comments_are_linear(spark):
    n = 20_000
    began = time.time()
    rows = metrics_of(spark, ["<!-- " * n, "[a " * n, "<!-- a -->" * 3 + "<!-- " * n + "*b*", "[x [b](c) ![d](e)"])
    assert [r.irregular_markdown for r in rows] == [0, 0, 4, 2]
    assert time.time() - began < 40  # four texts and the session's first plan


def test_rows_without_cluster_are_neither(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "doc_id long, cluster int")
    got = report.cluster_counts(df, 0).first()
    assert (got.ai, got.human, got.total, got.ai_pct) == (1, 1, 2, 50.0)
