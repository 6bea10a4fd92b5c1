"""Mixing sources to target weights, with DataFrame functions only.

Words are summed per source (combined map-side, so a hot source is only a
few partial sums), a water fill turns weights into target words per source,
and each document is emitted ``floor(rate)`` times plus one hash-seeded
Bernoulli copy whose probability is the fraction of the rate.

Defined cases: a null text has 0 words; a null source is a source of its own
and comes last; a source without words has target 0 and rate 0; a draw depends on the
seed, the id, the text and, where rows are equal in both, their number among
them, so rows of null or equal ids draw on their own; an empty table gives an empty result; columns of the input are never read other
than the named three, and all of them are kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, written

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_SOURCES = 100_000
SALTS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the md5 of key and seed: 52 bits, so exact as
    a double, and the same in any engine that has md5."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _text_md5() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def water_fill(caps: DataFrame, total: float) -> float:
    """The level L for which sum(min(cap, L * weight)) = total, with capped
    sources' excess reshared by weight until none is above its cap. Each
    round is one aggregate over the per-source table; only two sums reach
    the driver."""
    level = 0.0
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        row = caps.agg(
            F.sum(F.when(over, F.col("cap"))).alias("full"),
            F.sum(F.when(~over, F.col("weight"))).alias("open"),
        ).first()
        if not row["open"]:
            return level
        level, last = (total - (row["full"] or 0)) / row["open"], level
        if level <= last:
            return last


def source_rates(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2
) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``, ``rate``.
    ``sizes`` has ``source`` and ``size``. Sources in code-point order, null
    last, take the weights in turn."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = numbered(per, [F.col("source").asc_nulls_last()], "mix-sources")
    cycle = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * most)
    words = per.agg(F.sum("source_size")).first()[0] or 0
    level = water_fill(per, share * words)
    wanted = F.lit(level) * F.col("weight")
    target = F.when(F.col("cap") < wanted, F.col("cap").cast("double")).otherwise(wanted)
    target = F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def with_draws(docs: DataFrame, text_md5: Column) -> DataFrame:
    """``docs`` with ``_draw``, what a row's draw depends on: id, text and the
    number among the rows that are equal in both. Only those are numbered
    (within their source); a window's rows are streamed, not held."""
    draw = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text_md5)
    docs = docs.withColumn("_draw", draw)
    twice = docs.groupBy(F.col("_draw").alias("_twice")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_twice")
    twice = written(twice, "mix-twice")
    if twice.isEmpty():
        return docs.withColumn("_draw", F.concat("_draw", F.lit(":1")))
    same = F.col("_draw") == F.col("_twice")
    nth = F.row_number().over(Window.partitionBy("_draw", "source").orderBy("_draw"))
    rest = docs.join(twice, same, "left_semi").withColumn("_draw", F.concat_ws(":", "_draw", nth.cast("string")))
    return docs.join(twice, same, "left_anti").withColumn("_draw", F.concat("_draw", F.lit(":1"))).unionByName(rest)


def with_copies(docs: DataFrame, rates: DataFrame, seed: int = 7, id_col: str = "_draw") -> DataFrame:
    """Every row of ``docs`` (with ``_draw``) with its source's
    ``_source_size``, ``_target``, and ``_copies``. The rates are broadcast when their number is checked to
    be small; otherwise a salted join splits the rows of hot sources."""
    named = rates.select(
        F.col("source").alias("_source"), F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"), F.col("rate").alias("_rate"),
    )
    same = docs["source"].eqNullSafe(F.col("_source"))
    if rates.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(named), same, "left")
    else:
        named = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        docs = docs.withColumn("_dsalt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
        joined = docs.join(named, docs["source"].eqNullSafe(F.col("_source")) & (F.col("_dsalt") == F.col("_salt")), "left")
        joined = joined.drop("_salt", "_dsalt")
    whole = F.floor("_rate")
    extra = (uniform(F.col(id_col), seed) < F.col("_rate") - whole).cast("int")
    return joined.withColumn("_copies", (whole + extra).cast("int")).drop("_source", "_rate")


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` with all their columns, each as
    often as its source's rate asks for."""
    sizes = written(docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "mix-sizes")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", _text_md5().alias("md5"))
    out = with_copies(with_draws(rows, F.col("md5")), source_rates(sizes, weights, share, most), seed)
    out = out.withColumn("_copy", F.explode_outer(F.array_repeat(F.lit(1), F.col("_copies")))).where("_copy IS NOT NULL")
    return out.select("row.*")


def plan(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """What ``mix`` does, per document and without the texts: doc_id, size,
    source_size, target, taken. The texts are read once."""
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _text_md5().alias("md5")), "mix-sizes")
    out = with_copies(with_draws(sizes, F.col("md5")), source_rates(sizes, weights, share, most), seed)
    return out.select(
        "doc_id", "size", F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_copies") * F.col("size")).alias("taken"),
    )


ORACLE_SQL = r"""
WITH s AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) || ':'
           || row_number() OVER (PARTITION BY doc_id, coalesce(text, ''), source) AS draw,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM per
), r AS (
  SELECT *, source_size * 2 AS cap,
         sum(source_size * 2) OVER o - source_size * 2 AS full_before,
         (SELECT sum(weight) FROM w) - sum(weight) OVER o + weight AS open_from,
         (SELECT sum(source_size) FROM w) * 1.5 AS total
  FROM w WINDOW o AS (ORDER BY source_size * 2.0 / weight, source ROWS UNBOUNDED PRECEDING)
), l AS (
  SELECT max(CAST(total - full_before AS DOUBLE) / open_from) AS level FROM r
), t AS (
  SELECT source, source_size,
         CASE WHEN source_size = 0 THEN 0.0
              WHEN cap < level * weight THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target
  FROM r, l
), c AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0.0 ELSE target / source_size END AS rate,
         CAST(('0x' || substr(md5(draw || ':7'), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target,
       CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM c
"""
