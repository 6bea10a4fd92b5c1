"""Phrase counting for lexicons of any size, as a dictionary join.

``functions.phrases`` makes one regex of a family, which is right for hundreds
of phrases. Here the lexicon is a table ``(family, phrase)``:

* **anchors**: each phrase posts one gram of ``GRAM`` characters (a shorter
  phrase posts itself), the one that the fewest phrases of the lexicon hold,
  with its place in the phrase. Which one it is changes the work, not the result.
* **positions**: the flattened text (T2) is cut into blocks that know as many
  characters on either side as the longest phrase needs. Every position's grams
  are hashed in one pass over a block's characters, and those whose bucket holds
  no anchor are dropped there: a row is made only of the others. Their grams are
  looked up among the anchors, and the phrase is compared with the text around in
  the join's own condition, so only occurrences leave the scan's tasks. The
  buckets are a table of bits of fixed size. The anchors are broadcast behind a
  check of their number and bytes; beyond it the join is left to Spark.
* **overlaps**: within a text and family the occurrence that ends first counts,
  of those that end together the shortest, and the next one starts at or after
  its end: the rule of the regexes, with no need to drop phrases that contain
  others. Occurrences are first split into chains that overlap, by a window;
  the fold runs over one chain at a time, which is short unless a text
  repeats itself.

Defined cases: null texts, null or empty phrases and repeated phrases count
nothing (or once); a null family is a family; rows with equal keys keep their
own counts, by the md5 of their text, and equal rows are looked up once and
counted each; an empty lexicon finds nothing. A phrase may have at most
``LONGEST`` characters (an error otherwise).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .text_ops import with_text_states

GRAM = 5
BLOCK = 512
BUCKET_BITS = 20
LONGEST = 4096
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20

HIT = "family string, start long, end long, phrase string"


def postings(lexicon: DataFrame) -> DataFrame:
    """(family, phrase, at, gram): where in each phrase its anchor lies."""
    phrases = lexicon.select("family", "phrase").where("phrase <> ''").distinct()
    n = F.length("phrase")
    size = F.least(n, F.lit(GRAM))
    grams = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.col("phrase").substr(i + 1, size))
    grams = phrases.select("family", "phrase", F.posexplode(grams).alias("at", "gram"))
    held = grams.groupBy("gram").agg(F.count_distinct("phrase").alias("held"))
    best = F.min(F.struct("held", "at", "gram")).alias("best")
    return grams.join(held, "gram").groupBy("family", "phrase").agg(best).select("family", "phrase", "best.at", "best.gram")


def _blocks(texts: DataFrame, names: list[str], block: int, reach: int) -> DataFrame:
    """``names``, ``_base`` (place of the block's first character), ``_lead``
    (characters before it in the window), ``_n`` (its length), ``_window``."""
    # one linear pass; taking substrings of the whole text would be quadratic
    cut = texts.select(*names, F.regexp_extract_all("_t2", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)).alias("_parts"))

    def around(part: Column, i: Column) -> Column:
        before = F.coalesce(F.right(F.get("_parts", F.when(i > 0, i - 1)), F.lit(reach)), F.lit(""))
        after = F.coalesce(F.left(F.get("_parts", i + 1), F.lit(reach)), F.lit(""))
        return F.struct(
            (i.cast("long") * block).alias("base"), F.length(before).alias("lead"), F.length(part).alias("n"),
            F.concat(before, part, after).alias("window"),
        )

    # explode_outer: for explode, Spark infers a filter that computes the array once more
    parts = cut.select(*names, F.explode_outer(F.transform("_parts", around)).alias("_b")).where("_b IS NOT NULL")
    return parts.select(*names, *[F.col(f"_b.{c}").alias(f"_{c}") for c in ("base", "lead", "n", "window")])


# The functions below go to the tasks whole, as closures: a worker need not have this package.
MIX = 0x9E3779B97F4A7C15


def _bucket():
    """A gram's bucket: the upper bits of its rolling hash; -1 for a gram that
    is not UTF-8 (a block that holds one keeps all its places)."""
    shift, mix, full = 64 - BUCKET_BITS, MIX, (1 << 64) - 1

    def bucket(grams: pa.Array) -> pa.Array:
        out = []
        for raw in grams.cast(pa.large_binary()).to_pylist():
            h = 0
            try:
                for c in raw.decode():
                    h = (h + ord(c) + 1) * mix & full
                out.append(h >> shift)
            except UnicodeDecodeError:
                out.append(-1)
        return pa.array(out, pa.int32())

    return F.arrow_udf(bucket, "int")


def _places(held: bytes, sizes: list[int], rows: int = 128):
    """Of each block the places (from its first character on) where a gram of
    one of ``sizes`` falls into a bucket with anchors, as 8 * place + size."""
    shift, mix = np.uint64(64 - BUCKET_BITS), np.uint64(MIX)

    def of(raw: list[bytes], lead: np.ndarray, n: np.ndarray, length: np.ndarray, known: np.ndarray):
        """(codes, their number by block) of some blocks."""
        try:
            chars = np.frombuffer(b"".join(raw).decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
        except UnicodeDecodeError:
            chars = None
        if chars is None or len(chars) != length.sum():  # not UTF-8: block by block, and all places of such a block
            if len(raw) == 1:
                codes = (np.arange(n[0])[:, None] * 8 + np.array(sizes)).ravel()
                return codes, np.array([len(codes)])
            each = [of(raw[i : i + 1], *(a[i : i + 1] for a in (lead, n, length)), known) for i in range(len(raw))]
            return tuple(np.concatenate(parts) for parts in zip(*each))
        h, hits = np.zeros(len(chars), np.uint64), []
        chars += np.uint64(1)
        for size in range(1, min(sizes[-1], len(chars)) + 1):
            h = (h[: len(chars) - size + 1] + chars[size - 1 :]) * mix
            if size in sizes:
                hits.append(np.flatnonzero(known[(h >> shift).astype(np.intp)]) * 8 + size)
        hits = np.sort(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        ends = np.cumsum(length)
        block = np.searchsorted(ends, hits >> 3, "right")
        place = (hits >> 3) - (ends - length + lead)[block]
        keep = (place >= 0) & (place < n[block])
        return place[keep] * 8 + (hits[keep] & 7), np.bincount(block[keep], minlength=len(raw))

    def places(window: pa.Array, lead: pa.Array, n: pa.Array, length: pa.Array) -> pa.Array:
        known = np.unpackbits(np.frombuffer(held, np.uint8)).astype(bool)
        raw = window.cast(pa.large_binary()).to_pylist()
        numbers = [a.to_numpy(zero_copy_only=False).astype(np.int64) for a in (lead, n, length)]
        found = [of(raw[i : i + rows], *(a[i : i + rows] for a in numbers), known) for i in range(0, len(raw), rows)]
        codes, counts = (np.concatenate(parts) for parts in zip(*found)) if found else (np.zeros(0), np.zeros(0))
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.astype(np.int32)))

    return F.arrow_udf(places, "array<int>")


def _held(posts: DataFrame) -> bytes:
    """The buckets that hold anchors, as bits; 2**BUCKET_BITS of them at most
    come here, whatever the lexicon."""
    buckets = posts.select(_bucket()("gram").alias("bucket")).distinct().toArrow()["bucket"].to_numpy()
    known = np.zeros(1 << BUCKET_BITS, bool)
    known[buckets[buckets >= 0]] = True
    return np.packbits(known).tobytes()


def _keyed(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    return df.select(*keys, F.md5(F.col(text)).alias("_text"), text)


def occurrences(df: DataFrame, keys: list[str], lexicon: DataFrame, text: str = "text") -> DataFrame:
    """(keys, _text, family, start, end, phrase): every occurrence, overlaps
    included, once for equal rows; ``start`` and ``end`` (exclusive) are places
    in the flattened text, ``_text`` is the md5 of the raw one."""
    names = [*keys, "_text"]
    posts = materialize(postings(lexicon), "lexicon")
    size = posts.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("phrase")).alias("bytes"),
        F.max(F.length("phrase")).alias("longest"), F.sort_array(F.collect_set(F.length("gram"))).alias("sizes"),
    ).collect()[0]
    if not size["rows"]:
        return _keyed(df, keys, text).where("false").select(*names, *_no_hits())
    if size["longest"] > LONGEST:
        raise ValueError(f"a phrase has {size['longest']} characters, at most {LONGEST} are allowed")
    small = size["rows"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES
    texts = with_text_states(_keyed(df, keys, text), text).select(*names, "_t2")
    blocks = _blocks(texts, names, max(BLOCK, size["longest"]), size["longest"] - 1)
    code = _places(_held(posts), size["sizes"])("_window", "_lead", "_n", F.length("_window"))
    places = blocks.select(*names, "_base", "_lead", "_window", code.alias("_codes"))
    # explode_outer: for explode, Spark infers a filter that asks for the codes once more
    places = places.select(*names, "_base", "_lead", "_window", F.explode_outer("_codes").alias("_code"))
    at = F.shiftright("_code", 3)
    gram = F.col("_window").substr(F.col("_lead") + at + 1, F.col("_code").bitwiseAND(F.lit(7)))
    places = places.select(*names, "_base", "_window", at.alias("_p"), (F.col("_lead") + at).alias("_in"), gram.alias("_gram"))
    theirs = posts.select(*[F.col(c).alias(f"p_{c}") for c in posts.columns])
    first = F.col("_in") - F.col("p_at")
    same = (first >= 0) & (F.col("_window").substr(first + 1, F.length("p_phrase")) == F.col("p_phrase"))
    found = places.join(F.broadcast(theirs) if small else theirs, (F.col("_gram") == F.col("p_gram")) & same)
    start = F.col("_base") + F.col("_p") - F.col("p_at")
    found = found.select(
        *names, F.col("p_family").alias("family"), start.alias("start"),
        (start + F.length("p_phrase")).alias("end"), F.col("p_phrase").alias("phrase"),
    )
    # equal rows, and the last grams of a text at two sizes, find an occurrence again
    return found.distinct()


def _no_hits() -> list[Column]:
    return [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in HIT.split(", ")]


def resolved(found: DataFrame, keys: list[str]) -> DataFrame:
    """The occurrences that count (see the module's text); same columns."""
    names = [*keys, "_text", "family"]
    w = Window.partitionBy(*names).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    chains = found.withColumn("_new", F.when(F.col("start") < before, 0).otherwise(1))
    chains = chains.withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hit = F.struct("end", (-F.col("start")).alias("back"), "phrase")
    grouped = chains.groupBy(*names, "_chain").agg(F.sort_array(F.collect_list(hit)).alias("_hits"))
    # the fold: the end so far, and what was taken
    zero = F.struct(F.lit(0).cast("long").alias("to"), F.filter("_hits", lambda h: F.lit(False)).alias("taken"))
    taken = F.aggregate(
        "_hits", zero,
        lambda a, h: F.when(
            -h["back"] >= a["to"], F.struct(h["end"].alias("to"), F.array_append(a["taken"], h).alias("taken"))
        ).otherwise(a),
        lambda a: a["taken"],
    )
    out = grouped.select(*names, F.explode(taken).alias("_h"))
    return out.select(*names, (-F.col("_h.back")).alias("start"), F.col("_h.end").alias("end"), F.col("_h.phrase").alias("phrase"))


def lexicon_hits(df: DataFrame, keys: list[str], lexicon: DataFrame, text: str = "text") -> DataFrame:
    """(keys, _text, family, start, end, phrase): the counted occurrences, once for equal rows."""
    return resolved(occurrences(df, keys, lexicon, text), keys)


def lexicon_counts(df: DataFrame, keys: list[str], lexicon: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``df``: keys and ``counts``, a map of family to
    number, without those of 0. A null family is the entry ``null``."""
    names = [*keys, "_text"]
    n = lexicon_hits(df, keys, lexicon, text).groupBy(*names, "family").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct(F.coalesce("family", F.lit("null")), "n")
    n = n.groupBy(*names).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("counts"))
    n = n.select(*[F.col(c).alias(f"h{i}") for i, c in enumerate(names)], "counts")
    rows = _keyed(df, keys, text).drop(text)
    same = F.lit(True)
    for i, c in enumerate(names):
        same = same & F.col(c).eqNullSafe(F.col(f"h{i}"))
    counts = F.coalesce("counts", F.create_map().cast("map<string,bigint>"))
    return rows.join(n, same, "left").select(*keys, counts.alias("counts"))


def lexicon_totals(df: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """(family, phrase, n) over the whole table, as ``phrase_hits`` gives them
    for the built-in families. Equal texts are looked up once and weighed."""
    copies = df.where(F.col(text).isNotNull()).groupBy(F.md5(F.col(text)).alias("t")).agg(F.count(F.lit(1)).alias("copies"))
    per = lexicon_hits(df, [], lexicon, text).groupBy("_text", "family", "phrase").agg(F.count(F.lit(1)).alias("n"))
    per = per.join(copies, F.col("_text") == F.col("t"))
    return per.groupBy("family", "phrase").agg(F.sum(F.col("n") * F.col("copies")).alias("n"))
