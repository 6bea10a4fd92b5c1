"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names."""
    return posixpath.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once as a Parquet table in the shared folder and read
    it back: cuts lineage, and a lost executor re-reads files."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``rank`` (0-based, in the given order). A range sort numbers each
    partition on its own; only one count per partition is summed centrally."""
    ranged = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33).alias("_part")
    ranged = written(ranged, name).withColumn("_part", part)
    from pyspark.sql import Window

    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    # one row per partition of the range sort: bounded by the partition count
    out = ranged.join(F.broadcast(counts), "_part")
    rank = F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn("rank", rank).drop("_part", "_first", "_at")


ARROW_ROWS = 1024
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per application), so
    that they can import it wherever the driver was started. Whole texts go
    to them in batches of ``ARROW_ROWS`` rows, unless the session names
    another number than Spark's default; results don't depend on it."""
    import tempfile
    import zipfile
    from pathlib import Path

    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
