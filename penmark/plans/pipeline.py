"""End-to-end jobs: train (fit + name + report) and score.

The training corpus is reduced once to a narrow feature table
``(key, emoji_rate, f0..f14)``, checkpointed in the shared folder (so a lost
executor never re-runs the regex work), then compacted to distinct
weighted vectors for the k-means loop. Text never crosses a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.features import feature_columns, resolve_weights
from ..functions.metrics import with_text_metrics
from ..operators import kmeans, report
from ..session import materialize
from ..sources.model_io import Model


@dataclass
class TrainResult:
    model: Model
    features: DataFrame  # (keys..., emoji_rate, f0..f14), checkpointed
    points: DataFrame  # compact (f0..f14, w), checkpointed
    stats: list  # per-cluster (cluster, n, emoji_sum, emoji_mean)
    fit: kmeans.KMeansResult
    n_null: int = 0  # rows left out, their text being null


def feature_table(corpus: DataFrame, keys: list[str], text: str = "text",
                  weights: dict[str, float] | list[float] | None = None,
                  lexicons: dict[str, list[str]] | None = None) -> DataFrame:
    """(keys, emoji_rate, f0..f14) for every non-null text."""
    m = with_text_metrics(corpus.select(*keys, text).where(F.col(text).isNotNull()), text, lexicons=lexicons)
    return m.select(*keys, "emoji_rate", *feature_columns(weights))


def name_clusters(points: DataFrame, centroids: list[list[float]]) -> tuple[int, list]:
    """Mean raw emoji rate per predicted cluster (f0 is 2 × the rate, an exact
    halving), then the AI cluster. One small aggregate job."""
    k = len(centroids)
    labelled = points.select(
        kmeans.assign_expr(centroids).alias("cluster"), (F.col("f0") / F.lit(2.0)).alias("rate"), "w"
    )
    agg = labelled.groupBy("cluster").agg(F.sum("w").alias("n"), F.sum(F.col("rate") * F.col("w")).alias("emoji_sum"))
    by = {r["cluster"]: r for r in agg.collect()}
    stats = []
    for c in range(k):
        n = int(by[c]["n"]) if c in by else 0
        s = float(by[c]["emoji_sum"]) if c in by else 0.0
        stats.append({"cluster": c, "n": n, "emoji_sum": s, "emoji_mean": s / max(n, 1)})
    return report.ai_cluster_of(stats), stats


def train(
    corpus: DataFrame,
    keys: list[str],
    text: str = "text",
    k: int = lexicon.DEFAULT_K,
    runs: int = lexicon.DEFAULT_RUNS,
    max_iter: int = lexicon.DEFAULT_MAX_ITER,
    tol: float = lexicon.DEFAULT_TOL,
    seed: int = lexicon.DEFAULT_SEED,
    weights: dict[str, float] | list[float] | None = None,
    lexicons: dict[str, list[str]] | None = None,
) -> TrainResult:
    """Features, fit and naming. Rows without a text are left out and counted
    in the pass that reads them. ``weights`` (by metric, or all fifteen) and
    ``lexicons`` (by phrase family) replace the fixed ones and stay with the
    model, which scores by them."""
    weights = resolve_weights(weights)
    seen = Observation()
    counted = corpus.select(*keys, text).observe(seen, F.count_if(F.col(text).isNull()).alias("n_null"))
    feats = materialize(feature_table(counted, keys, text, weights, lexicons))
    n_null = int(seen.get["n_null"])
    # The compact points are written once (their partitions then follow file
    # size, not the shuffle setting: a cached aggregate keeps all of its
    # shuffle partitions), and the copy read back is kept in executor memory
    # for the loop; a lost block is re-read from the shared folder.
    points = materialize(kmeans.compact(feats), "points").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        res = kmeans.fit_points(points, k, runs, max_iter, tol, seed)  # raises on an empty corpus
    finally:
        points.unpersist()
    w0 = weights[0]
    if w0 == lexicon.FEATURE_WEIGHTS[0][1]:
        # naming from the fit's final pass: f0 = emoji_rate × its weight (2, an
        # exact scaling), so the mean raw rate per cluster needs no extra job
        stats = [
            {"cluster": st["cluster"], "n": int(st["n"]), "emoji_sum": st["f0_sum"] / w0,
             "emoji_mean": (st["f0_sum"] / w0) / max(int(st["n"]), 1)}
            for st in res.cluster_stats
        ]
    else:  # another weight, perhaps 0: from the raw rates, one small aggregate
        labelled = kmeans.predict(feats, res.centroids)
        stats = [r.asDict() for r in report.cluster_emoji_stats(labelled, k).orderBy("cluster").collect()]
    ai = report.ai_cluster_of(stats)
    model = Model(res.centroids, ai, res.inertia, res.n_iter, res.converged, res.run,
                  weights, lexicons or None, lexicon.digest(lexicons)).validate()
    return TrainResult(model, feats, points, stats, res, n_null)


def in_sample(result: TrainResult) -> DataFrame:
    """The training rows with their predicted cluster (E8 on the features)."""
    return kmeans.predict(result.features, result.model.centroids)


def training_report(result: TrainResult, date: str | None = None) -> DataFrame:
    """The published line; ``n_null`` counts the rows that training left out."""
    counts = report.cluster_counts(in_sample(result), result.model.ai_cluster, len(result.model.centroids))
    return report.corpus_report(counts.withColumn("n_null", F.col("n_null") + F.lit(result.n_null)), date)


def fit_pipeline(corpus: DataFrame, keys: list[str], text: str = "text", date: str | None = None, **fit_args):
    """Train, then score the training corpus and report on it: returns
    (model, in-sample rows with ``cluster``, one-row report)."""
    result = train(corpus, keys, text, **fit_args)
    return result.model, in_sample(result), training_report(result, date)


def write_scores(scored: DataFrame, path: str, mode: str = "errorifexists", by_cluster: bool = False) -> None:
    """Score sink: Parquet, optionally one folder per cluster (or verdict).

    Each task writes its own file per cluster; rows are never funnelled
    into one task per cluster, which a dominant cluster would turn into a
    single straggler."""
    writer = scored.write.mode(mode)
    if by_cluster:
        writer = writer.partitionBy("cluster" if "cluster" in scored.columns else "verdict")
    writer.parquet(path)


def cluster_samples(labelled: DataFrame, texts: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5,
                    seed: int = 42, cluster: str = "cluster") -> DataFrame:
    """Up to ``n`` seeded samples per cluster with their metrics summary and
    text: (cluster, sample_rank, key, summary, text).

    The sample is drawn on the narrow (key, cluster) table (a partial top-n
    per task before the shuffle), so at most ``n`` rows per cluster result,
    and metrics run only on the chosen rows."""
    from ..operators.scoring import metrics_summary

    picked = report.sample_per_cluster(labelled.select(key, cluster), n, key, seed, cluster)
    # n rows per cluster: Spark broadcasts them when they are few, and shuffles otherwise
    chosen = texts.select(key, text).join(picked, key)
    summarized = metrics_summary(with_text_metrics(chosen, text))
    return summarized.select(cluster, "sample_rank", key, "summary", text)
