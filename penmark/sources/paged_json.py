"""Landed pages of a paged JSON feed, read in parallel.

A feed page looks like ``{"devlogs": [{"text": ...}, ...], "pagination":
{"pages": N, "count": M}}`` (or ``projects`` with ``description``). Fetching
over HTTP is left to whatever lands the pages; here each landed page file
(``*_page_N.json``, or a ``page=N`` folder) is one JSON document, read with
an explicit schema (unknown fields ignored), one task per file split.

Feeds of very many pages land as page lines instead (``lines=True``): files
of JSON documents, one a line, each with its number in a field ``page``. The
number of files follows the bytes, not the pages, and files are split.

``strict`` mirrors a typed decode: a malformed file fails the read
(``FAILFAST``) and a missing/null text fails the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEEDS = {"devlogs": "text", "projects": "description"}
PART_BYTES = 16 << 20

PAGINATION = T.StructType(
    [T.StructField("pages", T.IntegerType(), True), T.StructField("count", T.IntegerType(), True)]
)


def envelope(kind: str, lines: bool = False) -> T.StructType:
    field = FEEDS[kind]
    item = T.StructType([T.StructField(field, T.StringType(), True)])
    number = [T.StructField("page", T.IntegerType(), True)] if lines else []
    return T.StructType(
        [*number, T.StructField(kind, T.ArrayType(item, True), True), T.StructField("pagination", PAGINATION, True)]
    )


def _page_number() -> Column:
    path = F.col("_metadata.file_path")
    from_name = F.regexp_extract(path, r"_page_(\d+)\.json", 1)
    from_dir = F.regexp_extract(path, r"/page=(\d+)/", 1)
    return F.coalesce(
        F.when(from_name != "", from_name.cast("int")), F.when(from_dir != "", from_dir.cast("int"))
    )


def read_envelopes(spark: SparkSession, path: str, kind: str = "devlogs", strict: bool = True, lines: bool = False) -> DataFrame:
    """One row per landed page: (page, items, pages, count, file)."""
    reader = spark.read.schema(envelope(kind, lines)).option("multiLine", not lines)
    reader = reader.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    raw = reader.json(path)
    return raw.select(
        F.col("page") if lines else _page_number().alias("page"),
        F.col(kind).alias("items"),
        F.col("pagination.pages").alias("pages"),
        F.col("pagination.count").alias("count"),
        F.col("_metadata.file_path").alias("file"),
    )


def _enveloped(lines: bool) -> Column:
    whole = F.col("items").isNotNull() & F.col("pages").isNotNull() & F.col("count").isNotNull()
    return whole & F.col("page").isNotNull() if lines else whole


def _decoded(kind: str, lines: bool) -> Column:
    """The page decodes as strict mode asks: list, pagination, no null text
    (and its number, where the page itself says it)."""
    return _enveloped(lines) & ~F.exists("items", lambda x: x[FEEDS[kind]].isNull())


def read_pages(spark: SparkSession, path: str, kind: str = "devlogs", strict: bool = True, lines: bool = False) -> DataFrame:
    """Flatten landed pages to rows (kind, page, pos, text). An empty page
    yields no rows; with ``strict`` a page without its list or pagination
    raises, and so does a null text."""
    field = FEEDS[kind]
    env = read_envelopes(spark, path, kind, strict, lines)
    items = F.col("items")
    if strict:
        items = F.when(_enveloped(lines), items).otherwise(F.raise_error(F.concat(F.lit(f"{kind}: page without list or pagination: "), "file")))
    rows = env.select("page", F.posexplode(items).alias("pos", "item"))
    text = F.col("item").getField(field)
    if strict:
        text = F.coalesce(text, F.raise_error(F.lit(f"{kind}: item without {field}")))
    return rows.select(F.lit(kind).alias("kind"), "page", "pos", text.alias("text"))


def page_audit(spark: SparkSession, path: str, kind: str = "devlogs", lines: bool = False) -> DataFrame:
    """One row: pages announced, pages found, items, pages that don't decode
    (``n_corrupt``), pages landed again (``n_repeated``: their rows would be
    read twice), and whether 1..pages are all present, once each, and decode.
    Only decoded pages count as found; a corrupt one makes the feed
    incomplete."""
    env = read_envelopes(spark, path, kind, strict=False, lines=lines)
    env = env.withColumn("ok", F.coalesce(_decoded(kind, lines), F.lit(False)))
    found = F.when(F.col("ok"), F.col("page"))
    agg = env.agg(
        F.count_distinct(found).alias("pages_found"),
        F.max("pages").alias("pages_expected"),
        F.max("count").alias("count_hint"),
        F.sum(F.when(F.col("items").isNull(), 0).otherwise(F.size("items"))).alias("items"),
        F.min(found).alias("min_page"),
        F.max(found).alias("max_page"),
        F.count_if(~F.col("ok")).alias("n_corrupt"),
        (F.count(found) - F.count_distinct(found)).alias("n_repeated"),
    )
    complete = (
        (F.col("n_corrupt") == 0)
        & (F.col("n_repeated") == 0)
        & (F.col("pages_found") == F.col("pages_expected"))
        & (F.col("min_page") == 1)
        & (F.col("max_page") == F.col("pages_expected"))
    )
    return agg.withColumn("complete", F.coalesce(complete, F.lit(False)))


def missing_pages(spark: SparkSession, path: str, kind: str = "devlogs", lines: bool = False) -> DataFrame:
    """Page numbers in 1..pages that have no landed file that decodes: a
    distributed range anti-joined with the pages found (only the single
    number ``pages`` reaches the driver)."""
    env = read_envelopes(spark, path, kind, strict=False, lines=lines)
    n = env.agg(F.max("pages")).collect()[0][0] or 0
    spine = spark.range(1, int(n) + 1).select(F.col("id").cast("int").alias("page"))
    found = env.where(_decoded(kind, lines)).select("page").distinct()
    return spine.join(found, "page", "left_anti")


def require_complete(spark: SparkSession, path: str, kind: str = "devlogs", lines: bool = False) -> None:
    """Raise unless every announced page is landed once and decodes: a model
    is never trained on part of a feed, nor on a part of it twice."""
    audit = page_audit(spark, path, kind, lines).first()
    if not audit["complete"]:
        raise ValueError(
            f"{kind} feed incomplete: {audit['pages_found']} of {audit['pages_expected']} pages decoded, "
            f"{audit['n_corrupt']} corrupt, {audit['n_repeated']} landed again"
        )


def _dealt(df: DataFrame, text: str, field: str, n_pages: int) -> DataFrame:
    """(page, item): rows go to pages by a hash of a per-row id (partition
    index + position, stable when a task is retried over the same input), so
    no global ordering is needed and no key value, however frequent, can
    overfill a page. Every page also has a row without an item, so a page
    that no row hashes to is landed empty and not missed by the audit."""
    h = F.xxhash64(F.monotonically_increasing_id())
    rows = df.select((F.pmod(h, F.lit(n_pages)) + 1).cast("int").alias("page"), F.struct(F.col(text).alias(field)).alias("item"))
    spine = df.sparkSession.range(1, n_pages + 1).select(F.col("id").cast("int").alias("page"))
    return rows.unionByName(spine, allowMissingColumns=True)


def _envelopes(dealt: DataFrame, kind: str, n_pages: int, total: int) -> DataFrame:
    pages = dealt.groupBy("page").agg(F.collect_list("item").alias(kind))
    return pages.select("page", kind, F.struct(F.lit(n_pages).alias("pages"), F.lit(total).alias("count")).alias("pagination"))


def _landing(df: DataFrame, text: str, kind: str, page_size: int, part_bytes: int) -> tuple[DataFrame, int, int]:
    """(pages, their number, bytes of text). Texts are shuffled once, to
    partitions of about ``part_bytes``, and pages are made of one partition at
    a time: a task holds so much, whatever the table or the file it writes."""
    sizes = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text)).alias("bytes")).first()
    n_pages = max(1, -(-sizes["rows"] // page_size))
    size = sizes["bytes"] or 0
    n_parts = min(n_pages, max(1, -(-size // part_bytes)))
    # the grouping needs no shuffle of its own after this one, nor a sort before it
    dealt = _dealt(df, text, FEEDS[kind], n_pages).repartition(n_parts, "page")
    return _envelopes(dealt, kind, n_pages, sizes["rows"]), n_pages, size


def write_pages(df: DataFrame, path: str, kind: str = "devlogs", text: str = "text",
                page_size: int = 100, mode: str = "errorifexists") -> None:
    """Land a table as feed pages of about ``page_size`` items, one JSON
    document per page folder. For feeds of very many pages see
    :func:`write_page_lines`."""
    out, _, _ = _landing(df, text, kind, page_size, PART_BYTES)
    # the grouping has dealt the pages by hash: each task writes its pages one after the other
    out.write.mode(mode).partitionBy("page").json(path)


def write_page_lines(df: DataFrame, path: str, kind: str = "devlogs", text: str = "text", page_size: int = 100,
                     file_bytes: int = 128 << 20, mode: str = "errorifexists") -> None:
    """Land a table as page lines: one JSON document per page and line, with
    its number inside, in files of about ``file_bytes`` of text. A file holds
    whatever pages hash to it, so 10^9 rows are as many files as their bytes
    ask for. A task takes the partitions of its file one after the other."""
    out, n_pages, size = _landing(df, text, kind, page_size, min(PART_BYTES, file_bytes))
    n_files = min(n_pages, max(1, -(-size // file_bytes)))
    out.coalesce(n_files).write.mode(mode).json(path)
