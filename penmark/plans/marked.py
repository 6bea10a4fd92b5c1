"""The marked corpus: ``documents`` with one of six markers appended by
``doc_id % 20`` (ids 6..19 get nothing), so every metric family fires on
whole tables. Both the Spark side and the SQL side are generated from the
one dict below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spec import sql_str
from ..sources.corpus import table

# Test fixture markers (FIXTURES.md §2).
MARKERS = {
    0: " ✨ It’s not just a modern dashboard — it’s more than a todo app 🚀 → built for developers…",
    1: "\nDevlog #1: Today, we fixed &amp; shipped #wip ... done",
    2: "\n\n## Features\n\n**Fast** and *small*, see [docs](http://x.y)\n\n> quoted\n\n• dot",
    3: " As a high school student I made the app (e.g. modern english).",
    4: "\nNote: “quoted” – – ⇒ x-y -> z\nhttps://x.y",
    5: " Then we us them all. MODERN Leetcode À　\n\n\n",
}
MODULUS = 20


def marker_column(key: str = "doc_id") -> Column:
    m = F.pmod(F.col(key), F.lit(MODULUS))
    expr = F.when(m == 0, F.lit(MARKERS[0]))
    for i in range(1, len(MARKERS)):
        expr = expr.when(m == i, F.lit(MARKERS[i]))
    return expr.otherwise(F.lit(""))


def marked_documents(spark: SparkSession, sf_dir: str, cols: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = [F.col(c) for c in cols if c != "text"]
    return docs.select(*out, F.concat(F.col("text"), marker_column()).alias("text"))


def marked_sql(cols: tuple[str, ...] = ("doc_id", "text")) -> str:
    cases = " ".join(f"WHEN {i} THEN {sql_str(v)}" for i, v in MARKERS.items())
    keep = ", ".join(c for c in cols if c != "text")
    keep = keep + ", " if keep else ""
    return (
        f"SELECT {keep}text || CASE doc_id % {MODULUS} {cases} ELSE '' END AS text FROM documents"
    )
