"""Scoring and explaining: distances, shares, verdict, metric listings.

All of it is row-local projection against centres embedded as literals:
no shuffle, no join, no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.features import feature_columns, linf_to_point
from ..functions.metrics import with_text_metrics


def point_confidence(df: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """Adds ``distances`` and ``sims`` (array<double>) from feature columns.

    d_c = L∞ to centre c, s_c = 1/(1+d_c), divided by Σs when Σs > 0. The
    number of centres is fixed, so everything is plain column arithmetic
    (no lambdas): it stays inside whole-stage code generation."""
    ds = [linf_to_point(c) for c in centroids]
    tmp = [f"_pc_d{i}" for i in range(len(ds))]
    out = df.withColumns({t: d for t, d in zip(tmp, ds)})
    raw = [F.lit(1.0) / (F.lit(1.0) + F.col(t)) for t in tmp]
    total = raw[0]
    for r in raw[1:]:
        total = total + r
    sims = F.array(*[F.when(total > 0, r / total).otherwise(r) for r in raw])
    return out.withColumn("distances", F.array(*[F.col(t) for t in tmp])).withColumn("sims", sims).drop(*tmp)


def chance_columns(ai_cluster: int) -> list[Column]:
    """``chance_ai`` = (s_ai / Σs)·100 (0 when the index is missing; null for
    a null text) and its complement."""
    ai = F.when(F.size("sims") > ai_cluster, F.get("sims", F.lit(ai_cluster))).otherwise(F.lit(0.0)) * F.lit(100.0)
    return [ai.alias("chance_ai"), (F.lit(100.0) - ai).alias("chance_human")]


def verdict_column(ai: str = "chance_ai", human: str = "chance_human") -> Column:
    """"AI" when chance_ai ≥ chance_human (a tie goes to AI), "Human" when it is less, else null."""
    return F.when(F.col(ai) >= F.col(human), F.lit("AI")).when(F.col(ai) < F.col(human), F.lit("Human"))


def score_features(df: DataFrame, centroids: list[list[float]], ai_cluster: int, keep: list[str]) -> DataFrame:
    """Score rows that already carry f0..f14."""
    scored = point_confidence(df, centroids)
    return scored.select(*keep, "distances", "sims", *chance_columns(ai_cluster)).withColumn(
        "verdict", verdict_column()
    )


def score(df: DataFrame, model, text: str = "text", keep: list[str] | None = None,
          with_metrics: bool = False) -> DataFrame:
    """Texts in, predictions out: metrics → features → shares → verdict.

    ``model`` is a :class:`penmark.sources.model_io.Model`; its own weights and
    phrase lists are used, and a model trained with other built-in lists than
    these is refused. ``keep`` lists
    pass-through columns (for example the key). With ``with_metrics`` the
    fifteen metrics come along as a nested struct ``metrics``."""
    keep = list(keep or [c for c in df.columns if c != text])
    model.check_lexicons()
    m = with_text_metrics(df.select(*keep, text), text, lexicons=model.lexicons)
    metric_struct = F.struct(*[F.col(c) for c in lexicon.METRIC_ORDER]).alias("metrics")
    feats = m.select(*keep, *feature_columns(model.weights), metric_struct)
    scored = point_confidence(feats, model.centroids)
    cols = [*keep, *chance_columns(model.ai_cluster)]
    if with_metrics:
        cols.append("metrics")
    return scored.select(*cols).withColumn("verdict", verdict_column())


# ------------------------------------------------------------ explanations
def _js_fixed2(v: Column) -> Column:
    """Number.prototype.toFixed(2): nearest on the exact binary value, exact
    ties (odd multiples of 1/8) upward."""
    eighths = v * F.lit(8.0)
    tie = (eighths == F.floor(eighths)) & (F.pmod(F.floor(eighths), F.lit(2)) == 1)
    up = (F.floor(v * F.lit(100.0)) + F.lit(1.0)) / F.lit(100.0)
    shown = F.when(tie, up).otherwise(v)
    return F.regexp_replace(F.format_number(shown, 2), ",", "")


def _plain_or(v: Column, fractional_text: Column) -> Column:
    integral = v == F.floor(v)
    return F.when(integral, F.format_string("%d", v.cast("long"))).otherwise(fractional_text)


def nonzero_metrics(df: DataFrame, out: str = "nonzero") -> DataFrame:
    """Adds ``{out}`` = array<struct<name,value>> of the non-zero metrics,
    sorted by value descending (ties keep record order), and
    ``{out}_text``, one ``  name: value`` line each (integers plain, other
    values with two decimals)."""
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.col(n).alias("value"))
            for i, n in enumerate(lexicon.METRIC_ORDER)
        ]
    )
    kept = F.filter(entries, lambda e: e["value"] != F.lit(0.0))
    ordered = F.array_sort(
        kept,
        lambda a, b: F.when(a["value"] > b["value"], F.lit(-1))
        .when(a["value"] < b["value"], F.lit(1))
        .when(a["ord"] < b["ord"], F.lit(-1))
        .when(a["ord"] > b["ord"], F.lit(1))
        .otherwise(F.lit(0)),
    )
    out_df = df.withColumn(f"_{out}", ordered)
    text = F.array_join(
        F.transform(
            f"_{out}",
            lambda e: F.concat(F.lit("  "), e["name"], F.lit(": "), _plain_or(e["value"], _js_fixed2(e["value"]))),
        ),
        "\n",
    )
    return (
        out_df.withColumn(out, F.transform(f"_{out}", lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value"))))
        .withColumn(f"{out}_text", text)
        .drop(f"_{out}")
    )


def metrics_summary(df: DataFrame, out: str = "summary") -> DataFrame:
    """The two-column text listing: non-zero metrics under their short names
    and fixed order; integers plain, other values with one decimal."""
    entries = F.array(
        *[F.struct(F.lit(short).alias("name"), F.col(m).alias("value")) for short, m in lexicon.SUMMARY_NAMES]
    )
    kept = F.filter(entries, lambda e: e["value"] != F.lit(0.0))

    def cell(e, i):
        col_no = F.pmod(i, F.lit(2))
        row_no = F.floor(i / F.lit(2))
        prefix = (
            F.when((row_no == 0) & (col_no == 0), F.lit(""))
            .when(col_no == 0, F.lit(" " * 10))
            .otherwise(F.lit("\t\t"))
        )
        value = _plain_or(e["value"], F.regexp_replace(F.format_number(e["value"], 1), ",", ""))
        end = F.when(col_no == 1, F.lit("\n")).otherwise(F.lit(""))
        return F.concat(prefix, F.rpad(e["name"], 10, " "), value, end)

    return df.withColumn(out, F.array_join(F.transform(kept, cell), ""))


def display_text(df: DataFrame, nonzero_text: str = "nonzero_text") -> DataFrame:
    """The live-scoring panel text: verdict, both chances, non-zero metrics."""
    return df.withColumn(
        "display",
        F.concat(
            F.lit("Text is most likely "), F.col("verdict"), F.lit("\n\nChance:\n  AI    = "),
            _js_fixed2(F.col("chance_ai")), F.lit("%\n  Human = "), _js_fixed2(F.col("chance_human")),
            F.lit("%\n\nNon-zero metrics:\n"), F.col(nonzero_text),
        ),
    )


def predict_text(spark, text: str, model) -> dict:
    """Score one text (the single-call library entry): a one-row DataFrame
    through the same projection; returns chance_ai, chance_human, verdict
    and the fifteen metrics."""
    df = spark.createDataFrame([(0, text)], "id long, text string")
    row = score(df, model, keep=["id"], with_metrics=True).collect()[0]
    return {
        "chance_ai": row["chance_ai"],
        "chance_human": row["chance_human"],
        "verdict": row["verdict"],
        "metrics": row["metrics"].asDict(),
    }
