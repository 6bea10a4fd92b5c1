"""Cluster statistics, naming, shares, samples and the corpus report.

Every aggregate here is a partial (map-side) aggregate over few groups, so
a cluster holding most of the rows never lands in one task; results are a
handful of rows. The per-cluster sample uses ``row_number() <= n``, which
Spark plans as a window group limit: each task keeps its own top n per
cluster before the shuffle, so at most ``n × clusters × tasks`` rows move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster_spine(df: DataFrame, k: int) -> DataFrame:
    return df.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))


def cluster_emoji_stats(labelled: DataFrame, k: int = 2, cluster: str = "cluster",
                        emoji: str = "emoji_rate") -> DataFrame:
    """(cluster, n, emoji_sum, emoji_mean) for every cluster 0..k-1; an empty
    cluster has n = 0 and mean 0 (sum / max(n, 1))."""
    in_range = F.col(cluster).between(0, k - 1)
    agg = labelled.where(in_range).groupBy(F.col(cluster).cast("int").alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(emoji).alias("emoji_sum")
    )
    # only clusters 0..k-1 pass: the aggregate has at most k rows, a proven bound
    out = cluster_spine(labelled, k).join(F.broadcast(agg), "cluster", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    s = F.coalesce(F.col("emoji_sum"), F.lit(0.0))
    return out.select(
        "cluster", n.alias("n"), s.alias("emoji_sum"), (s / F.greatest(n, F.lit(1))).alias("emoji_mean")
    )


def name_ai_cluster(stats: DataFrame) -> DataFrame:
    """One row: the cluster with the highest mean emoji rate (ties go to the
    higher cluster number, so with two clusters 0 wins only when strictly
    higher)."""
    return stats.agg(
        F.max_by("cluster", F.struct("emoji_mean", "cluster")).alias("ai_cluster")
    )


def ai_cluster_of(stats_rows: list) -> int:
    """Driver-side version over the k collected stats rows."""
    best = max(stats_rows, key=lambda r: (r["emoji_mean"], r["cluster"]))
    return int(best["cluster"])


def cluster_counts(labelled: DataFrame, ai_cluster: int | Column, k: int = 2,
                   cluster: str = "cluster") -> DataFrame:
    """One row: ai, human, total, both percentages (2 decimals) and n_null.
    Rows without a cluster (of null or undecodable texts) are neither ai nor
    human and not in the total; ``n_null`` counts them in the same pass. The
    percentages of no rows are null."""
    is_ai = F.col(cluster) == (ai_cluster if isinstance(ai_cluster, Column) else F.lit(ai_cluster))
    row = labelled.agg(
        F.sum(F.when(is_ai, 1).otherwise(0)).cast("long").alias("ai"),
        F.sum(F.when(~is_ai, 1).otherwise(0)).cast("long").alias("human"),
        F.count_if(F.col(cluster).isNull()).alias("n_null"),
    )
    total = F.col("ai") + F.col("human")
    return row.select(
        "ai", "human", total.alias("total"),
        F.round(F.try_divide(F.col("human") * F.lit(100.0), total), 2).alias("human_pct"),
        F.round(F.try_divide(F.col("ai") * F.lit(100.0), total), 2).alias("ai_pct"), "n_null",
    )


def report_by(labelled: DataFrame, cols: list[str], ai_cluster: int, cluster: str = "cluster",
              rollup: bool = False) -> DataFrame:
    """The same shares per group (for example per language or source);
    with ``rollup`` a grand-total row (group columns null) is added. Rows
    without a cluster are in ``n_null`` only; the percentages of a group of
    such rows are null."""
    is_ai = F.col(cluster) == F.lit(ai_cluster)
    grouped = labelled.rollup(*cols) if rollup else labelled.groupBy(*cols)
    out = grouped.agg(
        F.sum(F.when(is_ai, 1).otherwise(0)).cast("long").alias("ai"),
        F.sum(F.when(~is_ai, 1).otherwise(0)).cast("long").alias("human"),
        F.count_if(F.col(cluster).isNull()).alias("n_null"),
    )
    total = F.col("ai") + F.col("human")
    return out.select(
        *cols, "ai", "human", total.alias("total"),
        F.round(F.try_divide(F.col("human") * F.lit(100.0), total), 2).alias("human_pct"),
        F.round(F.try_divide(F.col("ai") * F.lit(100.0), total), 2).alias("ai_pct"), "n_null",
    )


def sample_key(key: str = "doc_id", seed: int = 42) -> Column:
    """A repeatable pseudo-random order: md5 of '<key>-<seed>'."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def sample_per_cluster(labelled: DataFrame, n: int = 5, key: str = "doc_id", seed: int = 42,
                       cluster: str = "cluster") -> DataFrame:
    """Up to ``n`` rows per cluster, uniform without replacement, seeded."""
    order = sample_key(key, seed)
    w = Window.partitionBy(cluster).orderBy(order, F.col(key))
    return labelled.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= n)


def sample_by(labelled: DataFrame, cols: list[str], n: int = 5, key: str = "doc_id", seed: int = 42,
              cluster: str = "cluster") -> DataFrame:
    """Up to ``n`` rows of every group and cluster, with ``sample_rank``: those
    with the smallest :func:`sample_key`. The sample of a union is the sample
    of the parts' samples, so parts (tasks, micro-batches) can be merged.
    Rows without a cluster are in no sample; a null group is a group."""
    order = [sample_key(key, seed), F.col(key)]
    w = Window.partitionBy(*cols, cluster).orderBy(*order)
    # a generator of one row keeps the filter from being rewritten through all that a verdict is made of
    rows = labelled.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in labelled.columns]))))
    rows = rows.where(F.col(cluster).isNotNull())
    return rows.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= n)


def report_with_samples(labelled: DataFrame, cols: list[str], ai_cluster: int, n: int = 5, key: str = "doc_id",
                        seed: int = 42, cluster: str = "cluster") -> DataFrame:
    """:func:`report_by` and, per group, the keys of up to ``n`` sampled rows of
    either kind (``ai_sample``, ``human_sample``, in the sample's order)."""
    is_ai = F.col(cluster) == F.lit(ai_cluster)
    # clusters other than the AI one are one kind, as in the counts
    kinds = labelled.select(*cols, key, is_ai.alias("_ai"))
    picked = sample_by(kinds, cols, n, key, seed, "_ai")

    def keys(of: Column, name: str) -> Column:
        rows = F.sort_array(F.collect_list(F.when(of, F.struct("sample_rank", F.col(key).alias("key")))))
        return F.transform(rows, lambda r: r["key"]).alias(name)

    # at most 2 n rows a group
    lists = picked.groupBy(*[F.col(c).alias(f"_s_{c}") for c in cols]).agg(keys(F.col("_ai"), "ai_sample"), keys(~F.col("_ai"), "human_sample"))
    out = report_by(labelled, cols, ai_cluster, cluster)
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    none = F.array().cast(lists.schema["ai_sample"].dataType)
    return out.join(lists, same, "left").select(*out.columns, *[F.coalesce(c, none).alias(c) for c in ("ai_sample", "human_sample")])


def report_text_columns(date: str | Column | None = None, suffix: str = "") -> list[Column]:
    """The published line's fields over a counts row (``ai``, ``human``,
    ``human_pct``, ``ai_pct``): date as ``MMM d, yyyy``, counts with
    thousands separators, percentages with two decimals."""
    d = F.current_date() if date is None else (F.to_date(F.lit(date)) if isinstance(date, str) else date)
    return [
        F.date_format(d, "MMM d, yyyy").alias("date"),
        F.format_number(F.col("human"), 0).alias(f"human{suffix}"),
        F.format_number(F.col("ai"), 0).alias(f"ai{suffix}"),
        F.format_string("%.2f", F.col("human_pct")).alias(f"human_pct{suffix}"),
        F.format_string("%.2f", F.col("ai_pct")).alias(f"ai_pct{suffix}"),
    ]


def corpus_report(counts: DataFrame, date: str | Column | None = None) -> DataFrame:
    """The published summary line (one row; see :func:`report_text_columns`),
    and the number of rows left out of it where the counts have one."""
    return counts.select(*report_text_columns(date), *[c for c in counts.columns if c == "n_null"])
