"""Phrase collocations, mined with Rabin-Karp fingerprints.

In chunks of whole texts, words are numbered, each word's bytes and each
n-gram's words are hashed by prefix polynomials (mod 2**64, an odd base, so
that the hash of any range is a difference of two prefixes times a power), and
equal fingerprints are counted. Within the chunk all occurrences are compared
with the first one, word by word; those of a collision become an entry of
their own. The shuffle adds up fingerprints, and only those that reach the
least count go on.

Lengths go one by one: an n-gram can only be frequent if both (n-1)-grams in it
are, so only those are counted whose parts are set in a table of ``BITS`` bits'
width made from the frequent fingerprints of the length before. The table has
a fixed size; where it fills up, more n-grams are shuffled, none is lost. The
pass over the texts that counts length n also gives the pointers (text, byte
range) of the frequent (n-1)-grams, with a second fingerprint from another
base: phrases that share one fingerprint but not the other fall apart there.
One pointer per phrase is read from its text, and counts are added up by
language and text. Across chunks, phrases of equal 128 bits are the same.

Defined cases: the words of a null or empty text are none; a null language is
``und``; a piece of any length is counted; repeated rows count repeatedly; ties
go by score, count and phrase; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes
from .common import ship, written

LONGEST = 5
LEAST = 100
TOP = 2000
CHUNK = 8 << 20
SLICE = 1 << 20
BITS = 26
SLOT_BITS = 19  # bits of the table that one row holds
ENTRIES = "n int, fp long, cnt long, chk long, row long, at int, len int"
_BASE = 0x9E3779B97F4A7C15
_CHECK = 0xD6E8FEB86659FD93
_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def prefixes(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Prefix polynomials: sums of ``values[j] * base**-j``, mod 2**64."""
    return np.r_[np.uint64(0), np.cumsum(values * _powers(pow(base, -1, 1 << 64), len(values)), dtype=np.uint64)]


def fingerprints(sums: np.ndarray, powers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges, independent of where they are."""
    return (sums[ends] - sums[starts]) * powers[starts]


class Chunk:
    """Words of some rows: number, piece, byte range, row, language."""

    def __init__(self, rows: np.ndarray, langs: list[str], texts: pa.Array):
        parts, pieces = [], 0
        for a, b in textbytes.slices(texts, SLICE):
            data, offsets = textbytes.joined(texts.slice(a, b - a))
            breaks = _BREAKS[data]
            starts, ends = textbytes.runs(~breaks & (data != 32) & (data != 9))
            row = np.searchsorted(offsets, starts, "right") - 1
            piece = np.cumsum(breaks, dtype=np.int32)[starts] + pieces
            pieces += int(breaks.sum())
            some = (row + a, starts - offsets[row], ends - offsets[row], piece)
            parts.append((*(x.astype(np.int32) for x in some), textbytes.words(data, starts, ends)))
        self.row, self.at, self.end, self.piece = (np.concatenate([p[k] for p in parts]) for k in range(4))
        self.keys = rows
        coded = pa.concat_arrays([p[4] for p in parts]).dictionary_encode()
        del parts
        # equal names get equal hashes; a name's bytes are hashed once
        self.word, names = coded.indices.to_numpy(), coded.dictionary
        raw = np.frombuffer(names.buffers()[2] or b"", np.uint8)
        bounds = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1] if len(names) else np.zeros(1, np.int64)
        low, raw = bounds[0], raw[bounds[0] : bounds[-1]]
        hashes = fingerprints(prefixes(raw.astype(np.uint64) + np.uint64(1)), _powers(_BASE, len(raw) + 1), bounds[:-1] - low, bounds[1:] - low)
        self.hash = _mix(hashes)
        tongue = {x: i for i, x in enumerate(dict.fromkeys(langs))}
        self.lang = np.array([tongue[x] for x in langs], np.int32)[self.row]
        seeds = [np.frombuffer(x.encode() + b"\0", np.uint8).astype(np.uint64) for x in tongue]
        self.seed = _mix(np.array([prefixes(s)[-1] for s in seeds], np.uint64))
        self.base = None

    def codes(self, at: np.ndarray, n: int, base: int = _BASE) -> np.ndarray:
        """Fingerprints of the n-grams that start at these words, language included."""
        if self.base != base:  # of one base at a time
            self.base, self.sums, self.powers = base, None, None
            self.sums, self.powers = prefixes(self.hash[self.word], base), _powers(base, len(self.word) + 1)
        return _mix(fingerprints(self.sums, self.powers, at, at + n) + self.seed[self.lang[at]] * np.uint64(2 * n + 1))

    def inside(self, n: int) -> np.ndarray:
        """Whether the n-gram that starts at a word stays in its piece."""
        last = max(len(self.word) - n + 1, 0)
        return self.piece[:last] == self.piece[n - 1 : n - 1 + last]

    def count(self, n: int, at: np.ndarray, fp: np.ndarray, pointers: bool) -> pa.RecordBatch:
        """Counts of the n-grams that start at these words, with pointers or without."""
        order = np.argsort(fp, kind="stable")
        at, fp = at[order], fp[order]
        new = np.r_[True, fp[1:] != fp[:-1]][: len(fp)]
        group = np.cumsum(new) - 1
        first = at[new][group] if len(at) else at
        other = self.lang[at] != self.lang[first]
        for k in range(n):
            other |= self.word[at + k] != self.word[first + k]
        count = np.bincount(group[~other], minlength=int(new.sum()))
        pointer, code = at[new], fp[new]
        if other.any():  # collisions: entries by language and words
            same: dict[tuple, list[int]] = {}
            for i in np.flatnonzero(other):
                key = (int(fp[i]), int(self.lang[at[i]]), *self.word[at[i] : at[i] + n].tolist())
                same.setdefault(key, [int(at[i]), 0])[1] += 1
            pointer = np.r_[pointer, np.array([p for p, _ in same.values()], np.int64)]
            count = np.r_[count, np.array([c for _, c in same.values()], np.int64)]
            code = np.r_[code, np.array([k[0] for k in same], np.uint64)]
        values = [pa.array(np.full(len(pointer), n), pa.int32()), pa.array(code.view(np.int64), pa.int64()), pa.array(count, pa.int64())]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        if pointers:
            begin, end = self.at[pointer], self.end[pointer + n - 1]
            more = (self.codes(pointer, n, _CHECK).view(np.int64), self.keys[self.row[pointer]], begin, end - begin)
            values += [pa.array(v, k) for v, k in zip(more, kinds)]
        else:
            values += [pa.nulls(len(pointer), k) for k in kinds]
        return pa.RecordBatch.from_arrays(values, names=[c.split()[0] for c in ENTRIES.split(", ")])

    def entries(self, n: int, table: np.ndarray | None, longest: int, narrow: int = 0) -> Iterator[pa.RecordBatch]:
        """The n-grams whose parts may be frequent, and the (n-1)-grams that
        may be, with pointers (so have those of the longest length)."""
        clear = np.uint64(-1 << narrow & (1 << 64) - 1)
        keep = self.inside(n)
        if table is not None:
            part = np.flatnonzero(self.inside(n - 1))
            fp = self.codes(part, n - 1) & clear
            slot = fp >> np.uint64(64 - BITS)
            known = (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
            part, fp = part[known], fp[known]
            maybe = np.zeros(len(self.word) + 1, bool)
            maybe[part] = True
            yield self.count(n - 1, part, fp, True)
            del part, fp, slot, known
            keep &= maybe[: len(keep)] & maybe[1 : len(keep) + 1]
        at = np.flatnonzero(keep)
        yield self.count(n, at, self.codes(at, n) & clear, n == longest)


def _count(rows: DataFrame, n: int, shared, longest: int, narrow: int) -> DataFrame:
    """Entries of all chunks for one length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if shared is None else shared.value
        kept: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for a, b in textbytes.slices(batch.column("text"), CHUNK):
                kept.append(batch.slice(a, b - a))
                size += kept[-1].nbytes
                if size >= CHUNK:
                    yield from chunk(kept).entries(n, table, longest, narrow)
                    kept, size = [], 0
        if kept:
            yield from chunk(kept).entries(n, table, longest, narrow)

    def chunk(kept: list[pa.RecordBatch]) -> Chunk:
        whole = pa.Table.from_batches(kept)
        one = lambda c: whole.column(c).combine_chunks()
        return Chunk(one("row").to_numpy(), one("lang").to_pylist(), one("text"))

    return rows.mapInArrow(count, ENTRIES)


def _table(frequent: DataFrame):
    """The bit table of the frequent fingerprints, made in rows of
    ``2**SLOT_BITS`` bits by the tasks; its size is fixed."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column("fp").to_numpy().view(np.uint64) >> np.uint64(64 - BITS)
            for k in np.unique(slot >> np.uint64(SLOT_BITS)).tolist():
                mine = part.setdefault(k, np.zeros(1 << SLOT_BITS, bool))
                mine[(slot[slot >> np.uint64(SLOT_BITS) == k] & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.keys(), pa.int64()), pa.array([np.packbits(v, bitorder="little").tobytes() for v in part.values()], pa.binary())], names=["slot", "bits"]
        )

    slot = F.shiftrightunsigned("fp", 64 - BITS + SLOT_BITS)
    rows = frequent.select("fp").distinct().repartition(1 << (BITS - SLOT_BITS) >> 3, slot).mapInArrow(bits, "slot long, bits binary")
    out = np.zeros(1 << (BITS - 3), np.uint8)
    wide = 1 << (SLOT_BITS - 3)
    for r in rows.toLocalIterator():  # 2**(BITS - SLOT_BITS) rows, whatever the input
        out[r.slot * wide : (r.slot + 1) * wide] = np.frombuffer(r.bits, np.uint8)
    return frequent.sparkSession.sparkContext.broadcast(out)


def _read(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """lang, phrase, n, cnt: the pointers' texts, words joined by one space."""
    # as many pointers as the text has n-grams, at most
    pointers = entries.groupBy(F.col("row").alias("p_row")).agg(F.collect_list(F.struct("n", "at", "len", "cnt")).alias("ps"))
    texts = rows.join(pointers.select("p_row"), F.col("row") == F.col("p_row"), "left_semi").dropDuplicates(["row"])
    both = texts.join(pointers, F.col("row") == F.col("p_row")).select("lang", "text", "ps")

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                owner = pc.list_parent_indices(some.column("ps")).to_numpy()
                n, at, size, cnt = (pc.struct_field(some.column("ps").flatten(), k) for k in range(4))
                data, offsets = textbytes.joined(some.column("text"))
                starts = offsets[owner] + at.to_numpy()
                index, names = textbytes.coded(data, starts, starts + size.to_numpy())
                said = [" ".join(w for w in x.decode().replace("\t", " ").split(" ") if w) for x in names.to_pylist()]
                phrase = pa.array(said, pa.string()).take(pa.array(index))
                yield pa.RecordBatch.from_arrays([some.column("lang").take(pa.array(owner)), phrase, n, cnt], names=["lang", "phrase", "n", "cnt"])

    return both.mapInArrow(phrases, "lang string, phrase string, n int, cnt long")


def frequencies(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, narrow: int = 0) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n, f) of all phrases of up to ``longest`` words with f >=
    ``least``, and (lang, n): all word occurrences. ``narrow`` clears bits of the
    fingerprints (for tests of collisions)."""
    spark = docs.sparkSession
    ship(spark)
    lang = F.coalesce("lang", F.lit("und"))
    rows = docs.select(F.xxhash64("doc_id", lang, "text").alias("row"), lang.alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    found, shared = None, None
    same = Window.partitionBy("n", "fp", "chk")
    for n in range(1, longest + 1):
        entries = _count(rows, n, shared, longest, narrow)
        # one entry per chunk and fingerprint at most, but for collisions; of each the smallest pointer stays
        entries = entries.withColumn("total", F.sum("cnt").over(same)).withColumn("nth", F.row_number().over(same.orderBy("row", "at")))
        frequent = entries.where((F.col("total") >= least) & (F.col("nth") == 1)).withColumn("cnt", F.col("total")).drop("total", "nth")
        frequent = written(frequent, f"phrases-{n}")
        pointers = frequent.where("row is not null")
        found = pointers if found is None else found.unionByName(pointers)
        if n < longest:
            candidates = frequent.where(F.col("n") == n)
            if candidates.isEmpty():
                break
            shared = _table(candidates)
    phrases = _read(rows, found).groupBy("lang", "phrase", "n").agg(F.sum("cnt").alias("f"))
    return written(phrases, "phrases"), written(_words(rows), "words")


def _words(rows: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for a, b in textbytes.slices(batch.column("text"), SLICE):
                data, offsets = textbytes.joined(batch.column("text").slice(a, b - a))
                starts, _ = textbytes.runs(~_BREAKS[data] & (data != 32) & (data != 9))
                n = np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=b - a)
                yield pa.RecordBatch.from_arrays([pa.array(langs[a:b], pa.string()), pa.array(n, pa.int64())], names=["lang", "n"])

    return rows.select("lang", "text").mapInArrow(count, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def _cut(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def score_column() -> Column:
    """floor(1000 * a * n / (l * r)), exact: the products have up to 38 digits."""
    over = "cast(1000 * cast(a as decimal(16, 0)) as decimal(19, 0)) * cast(n as decimal(18, 0))"
    return F.expr(f"({over}) div (cast(l as decimal(19, 0)) * cast(r as decimal(18, 0)))")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, narrow: int = 0) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top``."""
    known, totals = frequencies(docs, longest, least, narrow)
    words = F.split("phrase", " ", -1)
    long = known.where(F.col("n") >= 2).select("lang", "phrase", F.col("n").alias("size"), F.col("f").alias("a"))
    # cuts: both parts are frequent as the phrase is
    cuts = long.select("lang", "phrase", "size", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _cut(F.col("w"), F.lit(1), F.col("k")).alias("left"), _cut(F.col("w"), F.col("k") + 1, F.col("size")).alias("right"))
    part = lambda side, f: known.select(F.col("lang").alias(f"{f}_lang"), F.col("phrase").alias(f"{f}_phrase"), F.col("f").alias(f))
    for side, f in (("left", "l"), ("right", "r")):
        cuts = cuts.join(part(side, f), (F.col("lang") == F.col(f"{f}_lang")) & (F.col(side) == F.col(f"{f}_phrase"))).drop(f"{f}_lang", f"{f}_phrase")
    cuts = cuts.join(totals.select(F.col("lang").alias("t_lang"), F.col("n")), F.col("lang") == F.col("t_lang")).drop("t_lang")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score_column().alias("score"), "k", "l", "r")).alias("c"))
    scored = scored.select("lang", "phrase", "a", "n", "c.score", "c.l", "c.r")

    # phrases inside a longer one that occurs as often
    w = long.where(F.col("size") >= 3).select("lang", "size", "a", words.alias("w"))
    inner = w.select("lang", "size", "a", "w", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i"))
    inner = inner.select(F.col("lang").alias("i_lang"), _cut(F.col("w"), F.col("i"), F.col("m")).alias("i_phrase"), "a")
    inner = inner.groupBy("i_lang", "i_phrase").agg(F.max("a").alias("most"))
    covered = (F.col("lang") == F.col("i_lang")) & (F.col("phrase") == F.col("i_phrase")) & (100 * F.col("most") >= 100 * F.col("a"))
    scored = scored.join(inner, covered, "left_anti")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d
), t AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang
), g AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)
), f AS (
  SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= 100
), c AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m >= 2
), s AS (
  SELECT c.lang, c.m, c.phrase, a, l.f AS l, r.f AS r, t.n, k,
         CAST((1000::HUGEINT * a * t.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:c.m], ' ') JOIN t ON t.lang = c.lang
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), i AS (
  SELECT lang, array_to_string(w[j:j + o - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, m, w, a, o, unnest(range(1, m - o + 2)) AS j FROM (SELECT lang, m, string_split(phrase, ' ') AS w, f AS a, unnest(range(2, m)) AS o FROM f WHERE m >= 3))
  GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b LEFT JOIN i ON b.lang = i.lang AND b.phrase = i.phrase WHERE i.most IS NULL OR 100 * i.most < 100 * a
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) <= 2000
"""
