"""Benchmark decontamination by winnowing, with DataFrame functions only.

Every text becomes 64-bit word hashes. Documents are cut into blocks of
``STRIDE`` words that overlap by a window, so that each window of ``SPAN``
words lies whole in some block. In each block the minimum K-gram hash of
every ``WINNOW`` consecutive K-grams is kept, with its position and the words
around it. Any shared span of ``K + WINNOW - 1 = SPAN`` words shares a kept
fingerprint. Documents' fingerprints are joined with those of the items, and
each hit is extended along its diagonal to the windows that it lies in.

An item of fewer than ``SPAN`` words is one window of its own length; for each
such length that occurs, all grams of that length are compared.

Equal words are equal 64-bit hashes, compared for at least a whole window.
The items' fingerprints are broadcast when their number is checked to be at
most ``BROADCAST_ROWS``; beyond, the join is left to Spark (shuffled, with
its skew handling).

Defined cases: null or wordless texts have no words and hit nothing; repeated
rows are judged alike; a null item id counts as the id ``null``; empty tables
give no hits or an empty result; other columns are not read and are kept by
``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, written

BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # all that is in no word, in either case
SPAN = 13
K = 6
WINNOW = SPAN - K + 1  # 8: a power of two, see _minima
STRIDE = 512
POS_BITS = 10  # a position in a block
BROADCAST_ROWS = 500_000


def _words(text: Column) -> Column:
    # splitting at what lies between is several times faster than finding words
    return F.array_remove(F.split(text, BETWEEN), "")


def _word_hashes(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)
    lower = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.transform(_words(lower), lambda w: F.xxhash64(w))


def _gram(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(k)])


def _head(array: Column, n: Column) -> Column:
    return F.slice(array, 1, F.greatest(n, F.lit(0)))


def _around(words: Column, pos: Column) -> Column:
    return F.array(*[F.get(words, F.when(pos + i >= 0, pos + i)) for i in range(K - SPAN, SPAN)])


def _blocks(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, ``base`` (first word's position), ``w`` (word hashes)."""
    overlap = SPAN - 1
    hashed = df.select(*keys, _word_hashes(F.col(text)).alias("all"))
    cuts = F.sequence(F.lit(0), F.greatest(F.size("all") - 1 - overlap, F.lit(0)), F.lit(STRIDE))
    # explode_outer: for explode, Spark infers a filter on the array and computes it a second time
    hashed = hashed.select(*keys, "all", F.explode_outer(cuts).alias("base"))
    return hashed.select(*keys, "base", F.slice("all", F.col("base") + 1, STRIDE + overlap).alias("w"))


def _with_next(values: str, other: str, step: int, how) -> Column:
    """``how(values[i], other[i + step])``; null beyond the end."""
    return F.zip_with(values, F.slice(other, step + 1, F.greatest(F.size(other) - step, F.lit(0))), how)


def _both(x: Column, y: Column) -> Column:
    return F.xxhash64(x, y)


def _less(x: Column, y: Column) -> Column:
    return F.least(x, y)


def _minima(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Winnowed fingerprints: ``keys``, ``base``, ``pos``, ``fp``."""
    low = (1 << POS_BITS) - 1
    n = F.size("w") - (K - 1)
    df = blocks.where(n >= WINNOW).select(*keys, "base", n.alias("n"), "w")
    # hashes of 2, 4 and K = 4 + 2 words
    df = df.withColumn("two", _with_next("w", "w", 1, _both))
    df = df.withColumn("four", _with_next("two", "two", 2, _both))
    df = df.withColumn("m", _head(_with_next("four", "two", 4, _both), F.col("n")))
    df = df.withColumn("m", F.transform("m", lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    # minima over 2, 4, 8 neighbours; null beyond the end, which least() skips
    for step in (1, 2, 4):
        df = df.withColumn("m", _with_next("m", "m", step, _less))
    df = df.withColumn("m", F.array_distinct(_head(F.col("m"), F.col("n") - (WINNOW - 1))))
    df = df.select(*keys, "base", F.explode_outer("m").alias("m")).where("m IS NOT NULL")
    return df.select(*keys, "base", F.col("m").bitwiseAND(F.lit(low)).cast("int").alias("pos"), F.col("m").bitwiseAND(F.lit(~low)).alias("fp"))


def _contexts(found: DataFrame, blocks: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    """``found`` (with ``keys``, ``base``, ``pos``) and the words around it."""
    words = blocks.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col("base").alias("b_base"), "w")
    same = F.col("base") == F.col("b_base")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    return found.join(words, same).select(*keys, "base", "pos", *more, _around(F.col("w"), F.col("pos")).alias("ctx"))


def _long_hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(starts of windows of SPAN words: key, class, start, len; and the items
    of each class, an item being in many). A class is a fingerprint of the
    items with the words around it, so a passage that many items share is
    compared once."""
    theirs = _blocks(items, ["item"], "text")
    found = _contexts(_minima(theirs, ["item"]), theirs, ["item"], ["fp"]).select("item", F.col("fp").alias("i_fp"), F.col("ctx").alias("i_ctx"))
    found = written(found.distinct(), "winnow-items")
    classes = found.select("i_fp", "i_ctx").distinct().withColumn("class", F.monotonically_increasing_id())
    classes = written(classes, "winnow-classes")
    members = found.join(classes, ["i_fp", "i_ctx"]).select("class", "item").distinct()
    prints = classes.select("i_fp").distinct()
    small = classes.count() <= BROADCAST_ROWS
    mine = _minima(_blocks(docs, ["key"], "text"), ["key"])
    hits = written(mine.join(F.broadcast(prints) if small else prints, F.col("fp") == F.col("i_fp")).select("key", "base", "pos", "fp"), "winnow-prints")
    # the words around them, of the documents with hits only
    some = hits.select(F.col("key").alias("h_key")).distinct()
    some = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
    again = _blocks(docs.join(some, F.col("key") == F.col("h_key"), "left_semi").dropDuplicates(["key"]), ["key"], "text")
    hits = _contexts(hits.distinct(), again, ["key"], ["fp"])
    hits = hits.join(F.broadcast(classes) if small else classes, F.col("fp") == F.col("i_fp"))
    same = F.zip_with("ctx", "i_ctx", lambda a, b: F.when(a == b, F.lit("1")).otherwise(F.lit("0")))
    # '1' where the words along the diagonal agree; a window starts where SPAN of them follow
    bits = F.array_join(same, "")
    runs = hits.select("key", "class", (F.col("base") + F.col("pos") - (SPAN - K)).alias("left"), bits.alias("bits"))
    starts = F.filter(F.sequence(F.lit(0), F.lit(SPAN - K)), lambda s: F.col("bits").substr(s + 1, F.lit(SPAN)) == "1" * SPAN)
    runs = runs.where(F.col("bits").contains("1" * SPAN)).select("key", "class", "left", F.explode(starts).alias("s"))
    return runs.select("key", "class", (F.col("left") + F.col("s")).alias("start"), F.lit(SPAN).alias("len")), members


def _short_hits(docs: DataFrame, items: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Occurrences of whole items of ``length`` words (fewer than SPAN), and
    the items of each class, which are those of one fingerprint."""
    i_words = _word_hashes(F.col("text"))
    mine = items.where(F.col("n_item") == length).select("item", i_words.alias("iw"))
    members = written(mine.select(_gram(F.col("iw"), F.lit(0), length).alias("class"), "item").distinct(), "winnow-short")
    mine = members.select(F.col("class").alias("i_fp")).distinct()
    if mine.count() <= BROADCAST_ROWS:
        mine = F.broadcast(mine)
    blocks = _blocks(docs, ["key"], "text")
    n = F.size("w") - (length - 1)
    grams = F.transform("w", lambda w, i: _gram(F.col("w"), i, length))
    rows = blocks.select("key", "base", F.posexplode_outer(_head(grams, n)).alias("pos", "fp")).where("fp IS NOT NULL")
    hits = rows.join(mine, F.col("fp") == F.col("i_fp"))
    return hits.select("key", F.col("fp").alias("class"), (F.col("base") + F.col("pos")).alias("start"), F.lit(length).alias("len")), members


def _word_count(text: str) -> Column:
    return F.size(_words(F.coalesce(F.col(text), F.lit("")))).cast("long")


def _key(doc_id: str, text: str) -> Column:
    """Rows with equal id and text are judged alike."""
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated, and the key of the row."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text", _word_count("text").alias("n_item")
    )
    items = written(items.where("n_item > 0"), "winnow-benchmark")
    lengths = [r[0] for r in items.where(F.col("n_item") < SPAN).select("n_item").distinct().collect()]  # at most SPAN - 1
    keyed = docs.select(_key("doc_id", "text").alias("key"), "text")
    hits, members = _long_hits(keyed, items.where(F.col("n_item") >= SPAN))
    members = members.withColumn("len", F.lit(SPAN))
    for length in sorted(lengths):
        more, names = _short_hits(keyed, items, int(length))
        hits, members = hits.unionByName(more), members.unionByName(names.withColumn("len", F.lit(length)))
    # overlapping blocks and repeated rows find a window again; once is enough
    hits = written(hits.distinct(), "winnow-hits")
    spans = hits.groupBy("key", "start").agg(F.max("len").alias("len"))
    spans = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).alias("n"), F.greatest(s["end"], a["to"]).alias("to")
        ),
    )
    spans = spans.select("key", covered["n"].cast("long").alias("hit"))
    # items only now, once for each class that a document meets
    names = hits.select("key", "class", "len").distinct().join(members, ["class", "len"]).select("key", "item").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("names"))
    per = spans.join(names, "key").select(F.col("key").alias("h_key"), "hit", "names")

    rows = docs.select(_key("doc_id", "text").alias("key"), "doc_id", _word_count("text").alias("n_words"))
    rows = rows.join(per, F.col("key").eqNullSafe(F.col("h_key")), "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return rows.select(
        "key", "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("names", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    bad = contamination(docs, benchmark).where("contaminated").select("key").distinct()
    return docs.join(bad, _key("doc_id", "text").eqNullSafe(bad["key"]), "left_anti")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), h AS (
  SELECT doc_id, item, i, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
