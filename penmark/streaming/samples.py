"""A running sample of a scored stream: up to n rows of every group and verdict.

Each micro-batch is reduced to its own sample (the ``row_number() <= n`` of the
batch plan, cut in every task before the shuffle, so a hot group moves few
rows), merged with the sample so far, and written as a new version beside it.
The sample of a union is the sample of the parts' samples, so after any number
of batches the newest version equals the batch sample over all rows. The
state is n rows for each group and verdict, whatever the stream's length;
group by columns of few values.

A version is named by its batch and read only when whole. A batch that is run
again starts from the version before it and writes the same rows once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.report import sample_by
from ..sources.corpus import is_complete
from .score_stream import score_stream

KEPT = 2  # versions: the newest and the one it was made from


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Batches whose versions lie in ``path``, whole or not."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removeprefix("version-")) for n in names if n.startswith("version-"))


def _at(path: str, batch: int) -> str:
    return f"{path.rstrip('/')}/version-{batch}"


def _newest(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    found = [v for v in _versions(spark, path) if before is None or v < before]
    return next((v for v in reversed(found) if is_complete(spark, _at(path, v))), None)


def _forget(spark: SparkSession, path: str, batch: int) -> None:
    """Remove the versions that nothing starts from any more."""
    jvm = spark.sparkContext._jvm
    whole = [v for v in _versions(spark, path) if v <= batch and is_complete(spark, _at(path, v))]
    for v in whole[:-KEPT]:
        old = jvm.org.apache.hadoop.fs.Path(_at(path, v))
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def merge_sample(batch: DataFrame, batch_id: int, path: str, cols: list[str], n: int, key: str, seed: int,
                 cluster: str = "verdict") -> None:
    """Merge one micro-batch of labelled rows into the sample at ``path``."""
    spark = batch.sparkSession
    kept = [*cols, cluster, key]
    rows = sample_by(batch.select(*kept), cols, n, key, seed, cluster)
    before = _newest(spark, path, batch_id)
    if before is not None:
        both = spark.read.schema(rows.schema).parquet(_at(path, before)).unionByName(rows).drop("sample_rank")
        rows = sample_by(both, cols, n, key, seed, cluster)
    rows.write.mode("overwrite").parquet(_at(path, batch_id))
    _forget(spark, path, batch_id)


def read_samples(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version: group columns, verdict, key, sample_rank;
    None before the first batch."""
    newest = _newest(spark, path)
    return None if newest is None else spark.read.parquet(_at(path, newest))


def start_sampling(stream_df: DataFrame, model, path: str, cols: list[str], n: int = 5, key: str = "doc_id",
                   seed: int = 42, text: str = "text", checkpoint: str | None = None, available_now: bool = True,
                   processing_time: str | None = None) -> StreamingQuery:
    """Score a stream and keep its running sample at ``path``. The checkpoint
    lies beside it unless given, so a restart resumes. Rows without a verdict
    (null texts) are in no sample."""
    scored = score_stream(stream_df, model, text=text, keep=[key, *cols])
    writer = scored.writeStream.option("checkpointLocation", checkpoint or f"{path.rstrip('/')}-checkpoint").foreachBatch(
        lambda batch, batch_id: merge_sample(batch, batch_id, path, cols, n, key, seed)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
