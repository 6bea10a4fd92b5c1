"""Connected components of a link table, by minimum labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """``links``: a, b (long). One row per linked node: node, comp, its
    component's smallest node. Each round every node takes the smallest label
    around it and then its label's label, so a chain halves; minima are
    combined before the shuffle, and Spark splits the joins of a node with
    many links. Every round is a table in the shared folder; only the number
    of changed labels reaches the driver."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a <> b").distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp"))
    labels = written(labels, "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n_node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, F.col("node") == F.col("n_node")).select("node", "comp", F.least("comp", "near").alias("next"))
        heads = labels.select(F.col("node").alias("h_node"), F.col("comp").alias("h_comp"))
        step = step.join(heads, F.col("next") == F.col("h_node")).select("node", F.col("comp").alias("was"), F.least("next", "h_comp").alias("comp"))
        step = written(step, "labels")
        labels = step.select("node", "comp")
        if not step.where("was <> comp").limit(1).count():
            return labels
