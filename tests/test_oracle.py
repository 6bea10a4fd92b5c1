"""Spark queries against their DuckDB twins on the small tables."""

import os

import duckdb
import pytest

import sys, os.path  # noqa: E401
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import __spark_entry__ as entry  # noqa: E402
from oracle_check import TABLES, digest  # noqa: E402
from penmark.plans.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
FAST = [
    "normalize_text", "split_sentences", "split_lines", "graphemes", "phrase_hits", "markdown_markers",
    "markdown_marked_docs", "markup_events", "markup_events_pages", "text_metrics", "text_metrics_pages", "text_metrics_conversations",
    "feature_vector", "linf_assign", "lloyd_3_rounds", "inertia_at_centres", "cluster_emoji_mean",
    "name_ai_cluster", "point_confidence", "score", "verdict", "nonzero_metrics", "metrics_summary",
    "cluster_report", "report_by_lang", "report_null_rows", "report_by_source_rollup", "sample_per_cluster", "corpus_union",
    "report_by_kind", "cluster_samples", "page_audit", "page_lines", "page_lines_audit", "score_display",
    "kmeans_fit", "score_fitted", "training_report", "train_from_feeds", "score_own_weights", "lexicon_join_counts", "lexicon_join_totals",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_twin(spark, con, name):
    df = entry.queries()[name](spark, SF)
    s_rows, s_cols = [tuple(r) for r in df.collect()], df.columns
    res = con.execute(entry.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    d_rows = [tuple(r) for r in res.fetchall()]
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert digest(s_rows, s_cols)[0] == digest(d_rows, d_cols)[0]


def test_every_query_of_the_core_has_a_twin():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "emoji_rate" in df.columns
