"""Corpus assembly: union of feeds and a cache-aside corpus table."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*cols) if cols else df


def corpus_union(parts: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """UNION ALL of (kind, df, text column): keeps duplicates and order of
    feeds, adds ``kind`` so the source stays known."""
    out = None
    for kind, df, col in parts:
        one = df.select(F.lit(kind).alias("kind"), F.col(col).alias("text"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no parts")
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A short key that changes when any of the given files or folders
    changes (length and modification time, via the Hadoop file system)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    parts = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        st = p.getFileSystem(conf).getContentSummary(p)
        mt = p.getFileSystem(conf).getFileStatus(p).getModificationTime()
        parts.append(f"{path}:{st.getLength()}:{st.getFileCount()}:{mt}")
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:12]


def stored_bytes(spark: SparkSession, path: str) -> int:
    """The bytes of a file, or of all files in a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def is_complete(spark: SparkSession, path: str) -> bool:
    """A folder written by a finished Spark job carries a ``_SUCCESS`` marker."""
    return _exists(spark, path.rstrip("/") + "/_SUCCESS")


def _published(spark: SparkSession, manifest: str) -> str | None:
    """The data folder that a manifest names, or None where there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(manifest)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["data"]
    finally:
        stream.close()


def _publish(spark: SparkSession, manifest: str, content: dict) -> bool:
    """Write the manifest aside and rename it into place; False where another
    builder's is there already."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs_api = jvm.org.apache.hadoop.fs
    aside, place = fs_api.Path(f"{manifest}.{uuid.uuid4().hex}"), fs_api.Path(manifest)
    fs = place.getFileSystem(conf)
    out = fs.create(aside, False)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    files = fs_api.FileContext.getFileContext(fs.getUri(), conf)
    no_options = gateway.new_array(getattr(fs_api, "Options$Rename"), 0)  # none: an existing file is kept
    try:
        files.rename(fs.makeQualified(aside), fs.makeQualified(place), no_options)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        fs.delete(aside, False)
        return False
    return True


def corpus_or_build(spark: SparkSession, path: str, builder: Callable[[], DataFrame], source: str = "") -> DataFrame:
    """The corpus table under ``path`` that was built of ``source`` (a key such
    as :func:`fingerprint` gives), built and written if there is none.

    Each build writes a data folder of its own; when that is finished, a
    manifest named by the source is renamed into place, which never replaces
    one. So a changed source gives another manifest and a new table, a build
    that failed is never read, and of two builders at once the first to
    finish is read by both. A table that lost the race, or of an older source, is
    left as it is: a job may still be reading it."""
    base = path.rstrip("/")
    manifest = f"{base}/manifest-{hashlib.sha256(source.encode()).hexdigest()[:16]}.json"
    data = _published(spark, manifest)
    if data is None:
        mine = f"data-{uuid.uuid4().hex}"
        builder().write.parquet(f"{base}/{mine}")
        _publish(spark, manifest, {"source": source, "data": mine})
        data = _published(spark, manifest)
    return spark.read.parquet(f"{base}/{data}")
