"""Regression totals at sf0.01 (FIXTURES.md §2 and §4), from an independent
scratch computation: every family on the marked corpus, markup on pages."""

from pyspark.sql import functions as F

from penmark.functions import spec as S
from penmark.functions.metrics import metric_steps
from penmark.operators import text_ops
from penmark.plans.marked import marked_documents
from penmark.sources.corpus import table

SF = "/root/testdata/sf0.01"

EXPECTED = {
    "_n_buzz": 400, "_n_negative": 100, "_n_fancy": 50, "_n_not_just": 100, "_n_devlog": 100,
    "_n_ellipsis": 100, "_n_perspective": 150, "_n_backstory": 529, "_n_dash": 150, "_n_arrow": 100,
    "_n_quote": 200, "_n_html": 50, "_n_hashtags": 150, "_n_emoji": 100, "_n_labels": 100, "_n_sent": 38767,
}


def test_marked_corpus_totals(spark):
    m = S.apply_steps(marked_documents(spark, SF), metric_steps("text"))
    got = m.agg(*[F.sum(c).alias(c) for c in EXPECTED]).collect()[0].asDict()
    assert got == EXPECTED


def test_markup_totals(spark):
    pages = text_ops.markdown_breakdown(table(spark, SF, "pages", "page_id", "html"), ["page_id"], "html")
    docs = text_ops.markdown_breakdown(table(spark, SF, "documents", "doc_id", "text"), ["doc_id"], "text")
    assert pages.agg(F.sum("md_total")).collect()[0][0] == 17771
    assert docs.agg(F.sum("md_total")).collect()[0][0] == 0
