"""Registered queries: one per operator, each with its DuckDB twin.

Every query reads the given tables (whole) or data Spark derives from them.
Text-metric queries run on the marked corpus (``documents`` plus markers,
see :mod:`penmark.plans.marked`), because on plain ``documents`` nearly
every metric is zero. Most clustering queries use a model of three Lloyd rounds from the
per-feature minimum and maximum vectors, with the AI cluster named by mean
emoji rate; ``kmeans_fit`` and those after it use the whole fit.
Fractional outputs are rounded to 6 places and integer outputs are BIGINT
on both sides.
"""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import spec as S
from ..functions.metrics import METRICS, normalize_steps, with_text_metrics
from ..functions.normalize import graphemes
from ..functions.phrases import family_pattern
from ..operators import kmeans, lexicon_join, report, scoring, text_ops
from ..operators.text_ops import FAMILY_ORDER, MD_PARTS  # noqa: F401  (re-exported for the twins)
from ..plans import pipeline
from ..plans.marked import marked_documents
from ..session import ensure_checkpoint_dir, materialize
from ..sources import corpus as corpus_src
from ..sources import paged_json
from ..sources.model_io import Model, load_model, model_table, save_model
from ..streaming.score_stream import start_scoring
from ..streaming.samples import read_samples, start_sampling

FEATS = lexicon.FEATURE_NAMES
R = 6
REPORT_DATE = "2025-08-09"
LLOYD_ROUNDS = 3
STREAM_BATCHES = 4
STREAM_FILE_BYTES = 4 << 20
# a user's own weights (of some metrics) and phrases (of one family)
OWN_WEIGHTS = {"emoji_rate": 3.0, "labels": 4.0, "irregular_dashes": 2.5}
OWN_LEXICONS = {"devlog": ["devlog", "today, we", "we fixed", "wip"]}

Query = Callable[[SparkSession, str], DataFrame]


def _r(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, R)


def _long(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# ============================================================ Spark building
def _marked(spark, sf, cols=("doc_id", "text")) -> DataFrame:
    return marked_documents(spark, sf, cols)


def _normalized(spark, sf) -> DataFrame:
    return S.apply_steps(_marked(spark, sf), normalize_steps("text"))


def _metrics(spark, sf, cols=("doc_id", "text"), only: list[str] | None = None) -> DataFrame:
    return with_text_metrics(_marked(spark, sf, cols), "text", metrics=only)


def _features(spark, sf) -> DataFrame:
    return pipeline.feature_table(_marked(spark, sf, ("doc_id", "lang", "source", "text")), ["doc_id", "lang", "source"])


_model_cache: dict = {}
_model_lock = threading.Lock()


def _cache_key(spark: SparkSession, sf: str) -> tuple:
    """Per application (not per Python object id, which can be reused after
    a session stops), input folder and version of the table in it: a changed
    table is computed anew."""
    return (spark.sparkContext.applicationId, sf, corpus_src.fingerprint(spark, os.path.join(sf, "documents.parquet")))


def _lloyd_model(spark, sf):
    """(features, centres, counts, ai_cluster, stats) for the SQL-derivable model."""
    key = _cache_key(spark, sf)
    with _model_lock:
        if key not in _model_cache:
            feats = materialize(_features(spark, sf))
            points = materialize(kmeans.compact(feats))
            b = points.agg(*[F.min(f).alias(f"a{i}") for i, f in enumerate(FEATS)],
                           *[F.max(f).alias(f"b{i}") for i, f in enumerate(FEATS)]).collect()[0]
            init = [[b[f"a{i}"] for i in range(len(FEATS))], [b[f"b{i}"] for i in range(len(FEATS))]]
            centres, counts = kmeans.fixed_rounds(points, init, LLOYD_ROUNDS)
            ai, stats = pipeline.name_clusters(points, centres)
            _model_cache[key] = (feats, init, centres, counts, ai, stats)
        return _model_cache[key]


def q_normalize_text(spark, sf):
    df = _normalized(spark, sf)
    return df.select(
        "doc_id", F.md5("_t1").alias("t1_md5"), F.md5("_t2").alias("t2_md5"),
        _long(F.length("_t1")).alias("t1_len"), _long(F.length("_t2")).alias("t2_len"),
    )


def q_sentence_count(spark, sf):
    return _metrics(spark, sf, only=[]).select("doc_id", _long("sentence_count").alias("sentence_count"))


def q_split_sentences(spark, sf):
    out = text_ops.sentences(_marked(spark, sf), ["doc_id"])
    return out.select("doc_id", _long("pos").alias("pos"), "sentence")


def q_split_words(spark, sf):
    out = text_ops.words(_marked(spark, sf), ["doc_id"])
    return out.select("doc_id", _long("pos").alias("pos"), "word")


def q_split_lines(spark, sf):
    out = text_ops.lines(_marked(spark, sf), ["doc_id"])
    return out.select("doc_id", _long("pos").alias("pos"), "line")


def q_graphemes(spark, sf):
    df = corpus_src.table(spark, sf, "documents", "doc_id", "text")
    return df.select("doc_id", _long(F.size(graphemes(F.col("text")))).alias("n_graphemes"))


def q_emoji_rate(spark, sf):
    return _metrics(spark, sf, only=["emoji_rate"]).select("doc_id", _r("emoji_rate").alias("emoji_rate"))


def q_buzzword_rate(spark, sf):
    return _metrics(spark, sf, only=["buzzword_rate"]).select("doc_id", _r("buzzword_rate").alias("buzzword_rate"))


def q_phrase_family_counts(spark, sf):
    df = _normalized(spark, sf)
    return df.select(
        "doc_id", *[_long(F.regexp_count("_t2", F.lit(family_pattern(f)))).alias(f) for f in FAMILY_ORDER]
    )


def q_phrase_hits(spark, sf):
    return text_ops.phrase_hits(_marked(spark, sf))


def _builtin_lexicon(spark) -> DataFrame:
    rows = [(f, p) for f in FAMILY_ORDER for p in lexicon.FAMILIES[f]]
    return spark.createDataFrame(rows, "family string, phrase string")


def q_lexicon_join_counts(spark, sf):
    """The counts of the phrase families by dictionary join, as for lexicons
    that are too large for a regex."""
    out = lexicon_join.lexicon_counts(_marked(spark, sf), ["doc_id"], _builtin_lexicon(spark))
    return out.select("doc_id", *[F.coalesce(F.col("counts")[f], F.lit(0).cast("long")).alias(f) for f in FAMILY_ORDER])


def q_lexicon_join_totals(spark, sf):
    return lexicon_join.lexicon_totals(_marked(spark, sf), _builtin_lexicon(spark))


def q_char_marks(spark, sf):
    df = _metrics(spark, sf, only=["irregular_dashes", "irregular_arrows", "irregular_quotations", "irregular_ellipsis"])
    return df.select(
        "doc_id", _long("irregular_dashes").alias("dashes"), _long("irregular_arrows").alias("arrows"),
        _long("irregular_quotations").alias("quotes"), _long("irregular_ellipsis").alias("ellipsis"),
    )


def q_html_escapes(spark, sf):
    return _metrics(spark, sf, only=["html_escape_count"]).select("doc_id", _long("html_escape_count").alias("html_escape_count"))


def _markdown_parts(df: DataFrame, key: str, text: str) -> DataFrame:
    return text_ops.markdown_breakdown(df, [key], text)


def q_markdown_markers(spark, sf):
    pages = corpus_src.table(spark, sf, "pages", "page_id", "html")
    return _markdown_parts(pages, "page_id", "html")


def q_markdown_marked_docs(spark, sf):
    return _markdown_parts(_marked(spark, sf), "doc_id", "text")


def q_markup_events(spark, sf):
    return text_ops.markup_events(_marked(spark, sf), ["doc_id"])


def q_markup_events_pages(spark, sf):
    """Pages with a line for each tag: nearly all of it HTML blocks."""
    pages = corpus_src.table(spark, sf, "pages", "page_id", "html")
    return text_ops.markup_events(pages.withColumn("html", F.replace("html", F.lit("<"), F.lit("\n<"))), ["page_id"], "html")


def q_labels(spark, sf):
    return _metrics(spark, sf, only=["labels"]).select("doc_id", _long("labels").alias("labels"))


def q_hashtags(spark, sf):
    return _metrics(spark, sf, only=["hashtags"]).select("doc_id", _long("hashtags").alias("hashtags"))


def _metrics_out(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, *[_r(m).alias(m) for m in METRICS], _long("sentence_count").alias("sentence_count"))


def q_text_metrics(spark, sf):
    return _metrics_out(_metrics(spark, sf), "doc_id")


def q_text_metrics_plain(spark, sf):
    docs = corpus_src.table(spark, sf, "documents", "doc_id", "text")
    return _metrics_out(with_text_metrics(docs, "text"), "doc_id")


def q_text_metrics_pages(spark, sf):
    pages = corpus_src.table(spark, sf, "pages", "page_id", "html")
    return _metrics_out(with_text_metrics(pages, "html"), "page_id")


def q_text_metrics_conversations(spark, sf):
    conv = corpus_src.table(spark, sf, "conversations", "conv_id", "turn", "text")
    m = with_text_metrics(conv, "text")
    return m.select("conv_id", "turn", *[_r(x).alias(x) for x in METRICS], _long("sentence_count").alias("sentence_count"))


def q_feature_vector(spark, sf):
    return _features(spark, sf).select("doc_id", *[_r(f).alias(f) for f in FEATS])


def q_linf_assign(spark, sf):
    feats, init, *_ = _lloyd_model(spark, sf)
    d0, d1 = (kmeans.linf_to_point(c) for c in init)
    return feats.select(
        "doc_id", _r(d0).alias("d0"), _r(d1).alias("d1"),
        _long(kmeans.assign_expr(init)).alias("cluster"),
    )


def q_lloyd_3_rounds(spark, sf):
    _, _, centres, counts, *_ = _lloyd_model(spark, sf)
    rows = [(i, int(counts[i]), *[round(v, R) for v in c]) for i, c in enumerate(centres)]
    schema = "cluster long, n long, " + ", ".join(f"{f} double" for f in FEATS)
    return spark.createDataFrame(rows, schema)


def q_inertia_at_centres(spark, sf):
    feats, init, *_ = _lloyd_model(spark, sf)
    return feats.agg(_r(F.avg(kmeans.min_distance_expr(init))).alias("inertia"), _long(F.count(F.lit(1))).alias("n"))


def _labelled(spark, sf):
    feats, _, centres, _, ai, _ = _lloyd_model(spark, sf)
    return kmeans.predict(feats, centres), centres, ai


def q_cluster_emoji_mean(spark, sf):
    lab, centres, _ = _labelled(spark, sf)
    st = report.cluster_emoji_stats(lab, len(centres))
    return st.select(_long("cluster").alias("cluster"), _long("n").alias("n"),
                     _r("emoji_sum").alias("emoji_sum"), _r("emoji_mean").alias("emoji_mean"))


def q_name_ai_cluster(spark, sf):
    lab, centres, _ = _labelled(spark, sf)
    st = report.cluster_emoji_stats(lab, len(centres))
    return report.name_ai_cluster(st).select(_long("ai_cluster").alias("ai_cluster"))


def q_point_confidence(spark, sf):
    feats, _, centres, *_ = _lloyd_model(spark, sf)
    pc = scoring.point_confidence(feats, centres)
    return pc.select(
        "doc_id", _r(F.col("distances")[0]).alias("d0"), _r(F.col("distances")[1]).alias("d1"),
        _r(F.col("sims")[0]).alias("s0"), _r(F.col("sims")[1]).alias("s1"),
    )


def _scored(spark, sf):
    feats, _, centres, _, ai, _ = _lloyd_model(spark, sf)
    return scoring.score_features(feats, centres, ai, ["doc_id"])


def q_score(spark, sf):
    sc = _scored(spark, sf)
    return sc.select("doc_id", _r("chance_ai").alias("chance_ai"), _r("chance_human").alias("chance_human"), "verdict")


def q_score_texts(spark, sf):
    """End-to-end scoring from raw text with the model table (F2)."""
    _, _, centres, _, ai, _ = _lloyd_model(spark, sf)
    sc = scoring.score(_marked(spark, sf), Model(centres, ai), keep=["doc_id"])
    return sc.select("doc_id", _r("chance_ai").alias("chance_ai"), _r("chance_human").alias("chance_human"), "verdict")


def q_verdict(spark, sf):
    feats, _, centres, _, ai, _ = _lloyd_model(spark, sf)
    sc = scoring.score_features(kmeans.predict(feats, centres), centres, ai, ["doc_id", "cluster"])
    return sc.select("doc_id", "verdict", _long("cluster").alias("cluster"))


def q_nonzero_metrics(spark, sf):
    df = scoring.nonzero_metrics(_metrics(spark, sf))
    return df.select("doc_id", F.col("nonzero_text").alias("nonzero_text"), _long(F.size("nonzero")).alias("n_nonzero"))


def q_score_display(spark, sf):
    """The live-scoring panel: verdict, both chances, non-zero metrics."""
    _, _, centres, _, ai, _ = _lloyd_model(spark, sf)
    sc = scoring.score(_marked(spark, sf), Model(centres, ai), keep=["doc_id"], with_metrics=True)
    flat = sc.select("doc_id", "chance_ai", "chance_human", "verdict", "metrics.*")
    shown = scoring.display_text(scoring.nonzero_metrics(flat))
    return shown.select("doc_id", "display")


def q_metrics_summary(spark, sf):
    return scoring.metrics_summary(_metrics(spark, sf)).select("doc_id", "summary")


def q_cluster_report(spark, sf):
    lab, centres, ai = _labelled(spark, sf)
    counts = report.cluster_counts(lab, ai, len(centres))
    return counts.select(F.lit(ai).cast("long").alias("ai_cluster"), "ai", "human", "total", "human_pct", "ai_pct",
                         *report.report_text_columns(REPORT_DATE, suffix="_text"))


def q_report_by_lang(spark, sf):
    lab, _, ai = _labelled(spark, sf)
    return report.report_by(lab, ["lang"], ai)


def q_report_null_rows(spark, sf):
    """The report where every eleventh document has no cluster."""
    lab, _, ai = _labelled(spark, sf)
    lab = lab.withColumn("cluster", F.when(F.col("doc_id") % 11 != 0, F.col("cluster")))
    return report.report_by(lab, ["lang"], ai)


def q_report_by_source_rollup(spark, sf):
    lab, _, ai = _labelled(spark, sf)
    return report.report_by(lab, ["source"], ai, rollup=True)


def q_report_by_kind(spark, sf):
    """Score the union of both feeds (marked documents, conversations) with
    the model and report the shares per feed."""
    _, _, centres, _, ai, _ = _lloyd_model(spark, sf)
    docs = _marked(spark, sf, ("text",))
    conv = corpus_src.table(spark, sf, "conversations", "text")
    union = corpus_src.corpus_union([("documents", docs, "text"), ("conversations", conv, "text")])
    feats = pipeline.feature_table(union, ["kind"])
    return report.report_by(kmeans.predict(feats, centres), ["kind"], ai)


def q_sample_per_cluster(spark, sf):
    lab, _, _ = _labelled(spark, sf)
    s = report.sample_per_cluster(lab, 5, "doc_id", 42)
    return s.select(_long("cluster").alias("cluster"), "doc_id", _long("sample_rank").alias("sample_rank"))


def q_cluster_samples(spark, sf):
    """Five seeded samples per cluster with their metrics summary and text."""
    lab, _, _ = _labelled(spark, sf)
    out = pipeline.cluster_samples(lab, _marked(spark, sf), "doc_id", "text", 5, 42)
    return out.select(_long("cluster").alias("cluster"), _long("sample_rank").alias("sample_rank"), "doc_id",
                      "summary", F.md5("text").alias("text_md5"))


def q_corpus_union(spark, sf):
    docs = corpus_src.table(spark, sf, "documents", "text")
    conv = corpus_src.table(spark, sf, "conversations", "text")
    u = corpus_src.corpus_union([("documents", docs, "text"), ("conversations", conv, "text")])
    return u.select("kind", _long(F.length("text")).alias("n_chars"), F.md5("text").alias("text_md5"))


# -------------------------------------------------- fit, stream, landed files
def _scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


_train_cache: dict = {}


def _trained(spark, sf):
    key = _cache_key(spark, sf)
    with _model_lock:
        if key not in _train_cache:
            _train_cache[key] = pipeline.train(_marked(spark, sf, ("doc_id", "text")), ["doc_id"])
        return _train_cache[key]


def _rounded_model(df: DataFrame) -> DataFrame:
    return df.select(
        _long("cluster").alias("cluster"), "is_ai", *[_r(f"c{i}").alias(f"c{i}") for i in range(len(FEATS))],
        _r("inertia").alias("inertia"), _long("n_iter").alias("n_iter"), "converged", _long("run").alias("run"),
    )


def q_kmeans_fit(spark, sf):
    """The model table of the whole fit, seeding and restarts included."""
    return _rounded_model(model_table(spark, _trained(spark, sf).model))


def q_score_fitted(spark, sf):
    res = _trained(spark, sf)
    sc = scoring.score_features(res.features, res.model.centroids, res.model.ai_cluster, ["doc_id"])
    return sc.select("doc_id", _r("chance_ai").alias("chance_ai"), _r("chance_human").alias("chance_human"), "verdict")


def q_score_own_weights(spark, sf):
    """Train with own weights and phrases, save the model, load it, and score
    the texts with what the table holds."""
    docs = _marked(spark, sf)
    model = pipeline.train(docs, ["doc_id"], weights=OWN_WEIGHTS, lexicons=OWN_LEXICONS).model
    path = _scratch(spark, "own-model")
    save_model(model, spark, path)
    sc = scoring.score(docs, load_model(spark, path), keep=["doc_id"])
    return sc.select("doc_id", _r("chance_ai").alias("chance_ai"), _r("chance_human").alias("chance_human"), "verdict")


def q_training_report(spark, sf):
    return pipeline.training_report(_trained(spark, sf), REPORT_DATE)


def _landed_stream(spark, sf, name: str, cols: tuple[str, ...], file_bytes: int = STREAM_FILE_BYTES) -> DataFrame:
    """The marked corpus landed as Parquet files and read as a stream of
    ``STREAM_BATCHES`` micro-batches. The number of files follows the bytes,
    so a micro-batch of a large corpus has many, and as many tasks."""
    src = _scratch(spark, name)
    size = corpus_src.stored_bytes(spark, os.path.join(sf, "documents.parquet"))
    n_files = max(STREAM_BATCHES, -(-size // file_bytes))
    _marked(spark, sf, cols).repartition(n_files).write.parquet(src)
    schema = spark.read.parquet(src).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", -(-n_files // STREAM_BATCHES)).parquet(src)


def q_score_stream(spark, sf):
    """Land the marked corpus as Parquet files, stream them through the
    scoring projection (availableNow) into a Parquet sink, read the sink."""
    _, _, centres, _, ai, _ = _lloyd_model(spark, sf)
    stream = _landed_stream(spark, sf, "stream-src", ("doc_id", "text"))
    sink = _scratch(spark, "stream-sink")
    q = start_scoring(stream, Model(centres, ai), sink, keep=["doc_id"])
    q.awaitTermination()
    out = spark.read.parquet(sink)
    return out.select("doc_id", _r("chance_ai").alias("chance_ai"), _r("chance_human").alias("chance_human"), "verdict")


def q_report_samples_by_lang(spark, sf):
    """Shares per language, with the ids of three sampled rows of either kind."""
    lab, _, ai = _labelled(spark, sf)
    out = report.report_with_samples(lab, ["lang"], ai, 3)
    ids = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("ai_sample", "human_sample")]
    return out.select("lang", "ai", "human", "ai_pct", "n_null", *ids)


def q_score_stream_samples(spark, sf):
    """The marked corpus as a stream of four micro-batches; the running sample
    of five rows per language and verdict after the last of them."""
    _, _, centres, _, ai, _ = _lloyd_model(spark, sf)
    path = _scratch(spark, "sample-state")
    stream = _landed_stream(spark, sf, "sample-src", ("doc_id", "lang", "text"))
    start_sampling(stream, Model(centres, ai), path, ["lang"]).awaitTermination()
    return read_samples(spark, path).select("lang", "verdict", "doc_id", _long("sample_rank").alias("sample_rank"))


def _landed(spark, sf) -> tuple[str, str]:
    """Land documents as devlog pages and conversations as project pages
    (cache-aside: written once per version of the two source tables)."""
    key = corpus_src.fingerprint(spark, *[os.path.join(sf, f"{t}.parquet") for t in ("documents", "conversations")])
    base = os.path.join(ensure_checkpoint_dir(spark), "landed", f"{os.path.basename(sf.rstrip('/'))}-{key}")
    dev = os.path.join(base, "devlogs")
    proj = os.path.join(base, "projects")
    if not corpus_src.is_complete(spark, dev):
        docs = corpus_src.table(spark, sf, "documents", "doc_id", "text")
        paged_json.write_pages(docs, dev, "devlogs", "text", page_size=100, mode="overwrite")
    if not corpus_src.is_complete(spark, proj):
        conv = corpus_src.table(spark, sf, "conversations", "conv_id", "turn", "text")
        paged_json.write_pages(conv, proj, "projects", "text", page_size=100, mode="overwrite")
    return dev, proj


def _feeds(spark, dev: str, proj: str) -> list[tuple[str, DataFrame, str]]:
    """Both landed feeds; an incomplete one is refused."""
    feeds = (("devlogs", dev), ("projects", proj))
    for kind, path in feeds:
        paged_json.require_complete(spark, path, kind)
    return [(kind, paged_json.read_pages(spark, path, kind), "text") for kind, path in feeds]


def q_paged_json(spark, sf):
    """Landed pages → typed rows → union of both feeds, kept as a cache-aside
    corpus table (built and written once, then read)."""
    dev, proj = _landed(spark, sf)

    def build():
        return corpus_src.corpus_union(_feeds(spark, dev, proj))

    path = os.path.join(os.path.dirname(dev), "corpus")
    u = corpus_src.corpus_or_build(spark, path, build, corpus_src.fingerprint(spark, dev, proj))
    return u.select("kind", _long(F.length("text")).alias("n_chars"), F.md5("text").alias("text_md5"))


def _landed_lines(spark, sf) -> list[tuple[str, str]]:
    """The same feeds as page lines: (kind, path)."""
    base = os.path.dirname(_landed(spark, sf)[0])
    out = []
    for name, kind, cols in (("documents", "devlogs", ("doc_id", "text")), ("conversations", "projects", ("conv_id", "turn", "text"))):
        path = os.path.join(base, f"{kind}_lines")
        if not corpus_src.is_complete(spark, path):
            rows = corpus_src.table(spark, sf, name, *cols)
            field = paged_json.FEEDS[kind]
            paged_json.write_page_lines(rows.withColumnRenamed("text", field), path, kind, field, page_size=20, mode="overwrite")
        out.append((kind, path))
    return out


def q_page_lines(spark, sf):
    """Both feeds landed as page lines, audited, read and united."""
    feeds = _landed_lines(spark, sf)
    for kind, path in feeds:
        paged_json.require_complete(spark, path, kind, lines=True)
    u = corpus_src.corpus_union([(kind, paged_json.read_pages(spark, path, kind, lines=True), "text") for kind, path in feeds])
    return u.select("kind", _long(F.length("text")).alias("n_chars"), F.md5("text").alias("text_md5"))


def q_page_lines_audit(spark, sf):
    audits = [paged_json.page_audit(spark, path, kind, lines=True).withColumn("kind", F.lit(kind)) for kind, path in _landed_lines(spark, sf)]
    return audits[0].unionByName(audits[1]).select(
        "kind", *[_long(c).alias(c) for c in ("pages_expected", "items", "n_corrupt", "n_repeated")],
        (F.col("pages_found") == F.col("pages_expected")).alias("all_found"),
    )


def q_train_from_feeds(spark, sf):
    """The whole training job as the original runs it: landed feed pages →
    typed rows → union of both feeds (cache-aside) → metrics → fit → report."""
    dev, proj = _landed(spark, sf)

    def build():
        return corpus_src.corpus_union(_feeds(spark, dev, proj)).select(
            F.xxhash64("kind", "text").alias("row_key"), "kind", "text")

    path = os.path.join(os.path.dirname(dev), "corpus_keyed")
    corpus = corpus_src.corpus_or_build(spark, path, build, corpus_src.fingerprint(spark, dev, proj))
    res = pipeline.train(corpus, ["row_key", "kind"])
    rep = pipeline.training_report(res, REPORT_DATE)
    return rep.select(F.lit(res.model.ai_cluster).cast("long").alias("ai_cluster"), "*",
                      F.lit(res.model.n_iter).cast("long").alias("rounds"))


def q_page_audit(spark, sf):
    dev, _ = _landed(spark, sf)
    return paged_json.page_audit(spark, dev, "devlogs").select(
        _long("pages_found").alias("pages_found"), _long("pages_expected").alias("pages_expected"),
        _long("items").alias("items"), "complete",
    )


QUERIES: dict[str, Query] = {
    "normalize_text": q_normalize_text,
    "sentence_count": q_sentence_count,
    "split_sentences": q_split_sentences,
    "split_words": q_split_words,
    "split_lines": q_split_lines,
    "graphemes": q_graphemes,
    "emoji_rate": q_emoji_rate,
    "buzzword_rate": q_buzzword_rate,
    "phrase_family_counts": q_phrase_family_counts,
    "phrase_hits": q_phrase_hits,
    "lexicon_join_counts": q_lexicon_join_counts,
    "lexicon_join_totals": q_lexicon_join_totals,
    "char_marks": q_char_marks,
    "html_escapes": q_html_escapes,
    "markdown_markers": q_markdown_markers,
    "markdown_marked_docs": q_markdown_marked_docs,
    "markup_events": q_markup_events,
    "markup_events_pages": q_markup_events_pages,
    "labels": q_labels,
    "hashtags": q_hashtags,
    "text_metrics": q_text_metrics,
    "text_metrics_plain": q_text_metrics_plain,
    "text_metrics_pages": q_text_metrics_pages,
    "text_metrics_conversations": q_text_metrics_conversations,
    "feature_vector": q_feature_vector,
    "linf_assign": q_linf_assign,
    "lloyd_3_rounds": q_lloyd_3_rounds,
    "inertia_at_centres": q_inertia_at_centres,
    "cluster_emoji_mean": q_cluster_emoji_mean,
    "name_ai_cluster": q_name_ai_cluster,
    "point_confidence": q_point_confidence,
    "score": q_score,
    "score_texts": q_score_texts,
    "verdict": q_verdict,
    "nonzero_metrics": q_nonzero_metrics,
    "score_display": q_score_display,
    "metrics_summary": q_metrics_summary,
    "cluster_report": q_cluster_report,
    "report_by_lang": q_report_by_lang,
    "report_null_rows": q_report_null_rows,
    "report_by_source_rollup": q_report_by_source_rollup,
    "report_by_kind": q_report_by_kind,
    "sample_per_cluster": q_sample_per_cluster,
    "cluster_samples": q_cluster_samples,
    "corpus_union": q_corpus_union,
    "paged_json": q_paged_json,
    "kmeans_fit": q_kmeans_fit,
    "score_fitted": q_score_fitted,
    "score_own_weights": q_score_own_weights,
    "training_report": q_training_report,
    "score_stream": q_score_stream,
    "score_stream_samples": q_score_stream_samples,
    "report_samples_by_lang": q_report_samples_by_lang,
    "train_from_feeds": q_train_from_feeds,
    "page_audit": q_page_audit,
    "page_lines": q_page_lines,
    "page_lines_audit": q_page_lines_audit,
}
