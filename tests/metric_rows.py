"""Metrics of a few texts, for the golden and the random tests."""

from penmark.functions.metrics import with_text_metrics


def metrics_of(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in with_text_metrics(df).collect()}
    return [rows[i] for i in range(len(texts))]
