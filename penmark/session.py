"""Session helpers: a local session for tests and benches, and the shared
checkpoint folder for cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "penmark") -> SparkSession:
    """A local[N] session with AQE on and the UI off (tests and bench only)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The cluster's shared checkpoint folder, if one is configured."""
    try:
        d = spark.sparkContext.getCheckpointDir()
    except Exception:  # noqa: BLE001 - no classic SparkContext (e.g. a remote session)
        return spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        spark.sparkContext.setCheckpointDir(d)
    return d


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The configured shared checkpoint folder. Only on a local master (tests,
    a laptop) is a fresh scratch folder made when none is set; on a cluster a
    machine-local folder would be invisible to the executors, so it is an
    error to leave ``spark.checkpoint.dir`` unset there."""
    d = checkpoint_dir(spark)
    if d:
        return d
    master = spark.sparkContext.master or ""
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster (for example on HDFS or S3)")
    d = tempfile.mkdtemp(prefix="penmark-ckpt-", dir=os.environ.get("PENMARK_SCRATCH", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage reliably: write the rows once as a Parquet table in the
    shared checkpoint folder and read it back (one computation; a lost
    executor re-reads files instead of re-running the plan). On a cluster the
    folder must be set (see :func:`ensure_checkpoint_dir`)."""
    path = os.path.join(ensure_checkpoint_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
