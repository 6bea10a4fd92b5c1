"""Stateless re-scoring of a text stream with Structured Streaming.

Scoring is a pure projection, so the batch plan serves a stream as is:
no state, no watermark, append mode. The sink's checkpoint lies beside the
sink, so a restarted query resumes exactly once. Each micro-batch counts its
rows by verdict, and those without one, in the pass that scores them.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import score

COUNTS = "scored"


def score_stream(stream_df: DataFrame, model, text: str = "text", keep: list[str] | None = None,
                 with_metrics: bool = False) -> DataFrame:
    """The batch scoring projection applied to a streaming DataFrame."""
    return score(stream_df, model, text=text, keep=keep, with_metrics=with_metrics)


def _verdict_counts() -> list[Column]:
    verdict = F.col("verdict")
    return [
        F.count(F.lit(1)).alias("total"), F.count_if(verdict == "AI").alias("ai"),
        F.count_if(verdict == "Human").alias("human"), F.count_if(verdict.isNull()).alias("n_null"),
    ]


def batch_counts(progress) -> dict[str, int] | None:
    """total, ai, human and n_null (texts that are null, so without verdict) of
    one micro-batch, from its progress (``query.recentProgress``, or an
    ``onQueryProgress`` event's); None where the batch had no rows."""
    row = progress.observedMetrics.get(COUNTS)
    return row.asDict() if row is not None else None


def sink_counts(spark: SparkSession, sink_path: str) -> dict[str, int]:
    """The same counts over all that is in the sink, to set beside the sum of the batches'."""
    return spark.read.parquet(sink_path).agg(*_verdict_counts()).first().asDict()


def read_text_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def start_scoring(stream_df: DataFrame, model, sink_path: str, text: str = "text",
                  keep: list[str] | None = None, checkpoint: str | None = None,
                  available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Score a stream into Parquet files at ``sink_path`` (append). The
    checkpoint lies beside the sink unless given, so a restart resumes. The
    counts of each micro-batch are in its progress (see :func:`batch_counts`)."""
    checkpoint = checkpoint or f"{sink_path.rstrip('/')}-checkpoint"
    scored = score_stream(stream_df, model, text=text, keep=keep).observe(COUNTS, *_verdict_counts())
    writer = scored.writeStream.format("parquet").option("path", sink_path).option(
        "checkpointLocation", checkpoint
    ).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
