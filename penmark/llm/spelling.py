"""Groups of spelling variants, by FM-index search schemes over the vocabulary.

Words are counted over all texts. The vocabulary is sorted by length and word,
once as it is and once reversed, and cut into shards of about ``SYMBOLS``
symbols, so no prefix, however frequent, makes a large shard. For each shard a
task builds an FM-index over its delimited words: suffix ranks by prefix
doubling, the last column, and its positions ordered by symbol, in which one
binary search is one step of the search.

A word of one edit agrees with a word ``w`` either on w's whole first half or
on its whole second half. So each word is sent to the shards that can hold its
first half (and one symbol more, one less, or as many), where the half is
matched exactly from the delimiter on and extended across the rest with
exactly one error: intervals of suffix ranks are narrowed for all words of a
block at once, and branch into the symbols that occur in them. The same search
on the reversed words finds those that agree on the second half; there, words
that also agree on the first half are left out, as the first search has found
them. Each pair is thus found once, in one place, and only counts and best
candidates are shuffled.

Defined cases: the words of a null or empty text are none; a null doc_id reads
``null`` in the check sum; repeated rows count repeatedly; ties go to the
smallest word in code-point order; runs of any length are words; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes
from .common import numbered, ship, written

DROP = 199
LEAST = 6
OCCURS = 5
TIMES = 5
CHUNK = 16 << 20
SYMBOLS = 100_000
BLOCK = 20_000
WIDE = 96
LONG = 64

_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c


def _crcs(data: np.ndarray, starts: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each byte range, going on from ``before`` (a finished crc32)."""
    order = np.argsort(-size, kind="stable")
    at, left = starts[order], size[order]
    state = before[order] ^ np.uint32(0xFFFFFFFF)
    short = np.searchsorted(-left, -LONG, "left")
    done = np.array([zlib.crc32(data[a : a + n].tobytes(), int(s) ^ 0xFFFFFFFF) for a, n, s in zip(at[:short], left[:short], state[:short])], np.uint32)
    for k in range(int(left[short]) if short < len(left) else 0):
        end = np.searchsorted(-left, -k, "left")
        some = state[short:end]
        state[short:end] = _CRC[(some ^ data[at[short:end] + k]) & np.uint32(0xFF)] ^ (some >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    state[:short] = done
    out = np.empty(len(starts), np.uint32)
    out[order] = state
    return out


def count_words(texts: pa.Array, ids: pa.Array) -> Counter:
    """Occurrences of the words of some rows (bytes, A-Z lower-cased)."""
    data, offsets = textbytes.joined(texts)
    found: Counter = Counter()
    if not len(data):
        return found
    high = data == 0xC3
    inside = ((data >= 97) & (data <= 122)) | high
    inside[1:] |= high[:-1]
    starts, ends = textbytes.runs(inside)
    points = np.r_[0, np.cumsum(~high)]
    points = points[ends] - points[starts]
    long = points >= LEAST
    starts, ends, points = starts[long], ends[long], points[long]
    seeds = np.array([zlib.crc32(f"{'null' if i is None else i}:".encode()) for i in ids.to_pylist()], np.uint32)
    row = np.searchsorted(offsets, starts, "right") - 1
    sums = _crcs(data, starts, ends - starts, seeds[row])
    odd = np.flatnonzero(sums % DROP == 0)
    for i in odd:
        word = data[starts[i] : ends[i]].tobytes().decode()
        at = int(sums[i]) % len(word)
        word = word[:at] + word[at + 1 :]
        if len(word) >= LEAST:
            found[word.encode()] += 1
    starts, ends = np.delete(starts, odd), np.delete(ends, odd)
    index, names = textbytes.coded(data, starts, ends)
    for name, n in zip(names.to_pylist(), np.bincount(index, minlength=len(names)).tolist()):
        found[name] += n
    return found


def vocabulary(docs: DataFrame, occurs: int = OCCURS) -> DataFrame:
    """word, n: words of at least ``LEAST`` code points and ``occurs`` occurrences."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        seen = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for a, b in textbytes.slices(texts, CHUNK // 4):
                part = texts.slice(a, b - a)
                found.update(count_words(part, ids.slice(a, b - a)))
                seen += part.nbytes
                if seen >= CHUNK:
                    yield flush()
                    found, seen = Counter(), 0
        if found:
            yield flush()

    counts = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurs)


class Index:
    """FM-index of distinct words of one length (rows of a byte matrix), to be
    searched from the first symbol on. Suffixes end at their delimiter; equal
    ones are ordered by word."""

    def __init__(self, words: np.ndarray):
        n, size = words.shape
        self.n, self.size = n, size
        # reversed words: prepending a symbol there goes on to the right here
        text = np.concatenate([words[:, ::-1], np.zeros((n, 1), np.uint8)], 1)
        rank = text.astype(np.int64)
        step = 1
        while step <= size:
            rest = np.zeros_like(rank)
            rest[:, :-step] = rank[:, step:] + 1
            known, code = np.unique(rank * (int(rest.max()) + 1) + rest, return_inverse=True)
            rank = code.reshape(rank.shape)
            if len(known) == rank.size:
                break
            step *= 2
        order = np.lexsort((np.repeat(np.arange(n), size + 1), rank.ravel()))
        before = np.concatenate([np.zeros((n, 1), np.uint8), text[:, :-1]], 1)
        self.last = before.ravel()[order]
        self.word = order // (size + 1)
        self.rows = len(order)
        self.by_symbol = np.sort(self.last.astype(np.int64) * self.rows + np.arange(self.rows))
        self.symbols = np.unique(words).astype(np.int64)

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.by_symbol, symbol.astype(np.int64) * self.rows + at)

    def go_on(self, state: tuple, symbol: np.ndarray) -> tuple:
        """States (query, low, high) extended by their symbols; empty ones go."""
        low, high = self.step(symbol, state[1]), self.step(symbol, state[2])
        live = low < high
        return state[0][live], low[live], high[live]

    def branch(self, state: tuple, but: np.ndarray | None) -> tuple:
        """States extended by every symbol that occurs in them, except ``but``."""
        size = state[2] - state[1]
        wide = np.flatnonzero(size > WIDE)
        few = np.flatnonzero(size <= WIDE)
        of = np.repeat(few, size[few])
        pair = np.unique(of * 256 + self.last[textbytes.spans(state[1][few], size[few])])
        of, symbol = pair >> 8, pair & 255
        if len(wide):
            of = np.r_[of, np.repeat(wide, len(self.symbols))]
            symbol = np.r_[symbol, np.tile(self.symbols, len(wide))]
        live = symbol > 0
        if but is not None:
            live &= symbol != but[of]
        of, symbol = of[live], symbol[live]
        return self.go_on(tuple(s[of] for s in state), symbol)

    def near(self, queries: np.ndarray, exact: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of all words that begin with a query's first ``exact``
        symbols and differ by exactly one edit behind them. All queries have
        one length; each pair comes once."""
        m = queries.shape[1]
        everyone = np.arange(len(queries))
        state = (everyone, np.zeros(len(queries), np.int64), np.full(len(queries), self.n, np.int64))
        for j in range(exact):
            state = self.go_on(state, queries[state[0], j])
        none = (everyone[:0], state[1][:0], state[2][:0])
        wrong = none
        both = lambda a, b: tuple(np.concatenate(x) for x in zip(a, b))
        for j in range(exact, m + 1):
            here = queries[state[0], j] if j < m else None
            ahead = lambda s: self.go_on(s, queries[s[0], j])  # noqa: B023, E731 - used at once
            if self.size == m:  # another symbol instead
                fresh = self.branch(state, here) if j < m else none
                wrong = both(ahead(wrong), fresh) if j < m else wrong
            elif self.size == m + 1:  # a symbol before this one, but none like it: that is one behind it
                wrong = both(wrong, self.branch(state, here))
                wrong = ahead(wrong) if j < m else wrong
            else:  # without this symbol, the last of its run
                if j < m:
                    run_ends = here != queries[state[0], j + 1] if j + 1 < m else np.ones(len(here), bool)
                    wrong = both(ahead(wrong), tuple(s[run_ends] for s in state))
            if j < m:
                state = ahead(state)
        return wrong[0], self.word[wrong[1]]


def _matrix(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def _search(group: pa.Table) -> pa.Table:
    """One shard: the index rows and the queries sent to it."""
    back = group.column("back")[0].as_py()
    is_query = group.column("query").to_numpy()
    keys, counts = group.column("key").to_pylist(), group.column("n").to_numpy()
    mine = np.flatnonzero(~is_query)
    index = Index(_matrix([keys[i] for i in mine]))
    matrix = _matrix([keys[i] for i in mine])
    n_of = counts[mine]
    spelled = [keys[i][::-1] if back else keys[i] for i in mine]
    order = np.empty(len(mine), np.int64)
    order[sorted(range(len(mine)), key=spelled.__getitem__)] = np.arange(len(mine))
    out: list[tuple] = []
    asked = np.flatnonzero(is_query)
    size = np.fromiter((len(keys[i]) for i in asked), np.int64, len(asked))
    for m in np.unique(size).tolist():
        same = asked[size == m]
        half = m // 2
        exact = m - half if back else half
        for first in range(0, len(same), BLOCK):
            some = same[first : first + BLOCK]
            queries = _matrix([keys[i] for i in some])
            q, w = index.near(queries, exact)
            if back and len(q):  # those that agree on the first half are found forwards
                other = np.zeros(len(q), bool)
                for k in range(half):
                    other |= queries[q, m - half + k] != matrix[w, index.size - half + k]
                q, w = q[other], w[other]
            best = np.lexsort((order[w], -n_of[w], q))
            q, w = q[best], w[best]
            heads = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
            each = np.diff(np.r_[heads, len(q)])
            for h, k in zip(heads.tolist(), each.tolist()):
                key = keys[some[q[h]]]
                out.append((key[::-1] if back else key, k, int(n_of[w[h]]), spelled[w[h]]))
    columns = list(zip(*out)) or [(), (), (), ()]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``words``: word, n (distinct). word, n_near, and of its near words the
    one of largest n (best, best_n); words without near words are left out."""
    spark = words.sparkSession
    ship(spark)
    size = F.length("word")
    both = words.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("back"), size.alias("size"), "word", "n")
    both = both.select("back", "size", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")).alias("key"), "n")
    ranked = numbered(both, [F.col("back"), F.col("size"), F.col("key")], "spelling-order")
    firsts = ranked.groupBy(F.col("back").alias("f_back"), F.col("size").alias("f_size")).agg(F.min("rank").alias("first"))
    room = F.greatest(F.lit(1), F.floor(F.lit(symbols) / (F.col("size") + 1)))
    ranked = ranked.join(firsts, (F.col("back") == F.col("f_back")) & (F.col("size") == F.col("f_size")))
    shard = F.floor((F.col("rank") - F.col("first")) / room).cast("long")
    index = written(ranked.select("back", "size", shard.alias("shard"), "key", "n"), "spelling-index")
    # one row per shard of many thousand words
    cuts: dict[tuple[bool, int], list[str]] = {}
    for r in index.groupBy("back", "size", "shard").agg(F.min("key").alias("key")).orderBy("back", "size", "shard").toLocalIterator():
        cuts.setdefault((r.back, r.size), []).append(r.key)
    shared = spark.sparkContext.broadcast(cuts)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            out = []
            for back, m, key, n in zip(*(batch.column(c).to_pylist() for c in ("back", "size", "key", "n"))):
                half = key[: m - m // 2 if back else m // 2]
                for size in (m - 1, m, m + 1):
                    first = table.get((back, size))
                    if first:
                        low = max(bisect_right(first, half) - 1, 0)
                        for k in range(low, bisect_left(first, half + "￿")):
                            out.append((back, size, k, key, n))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.bool_(), pa.int32(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["back", "size", "shard", "key", "n"])

    queries = index.select("back", "size", "key", "n").mapInArrow(route, "back boolean, size int, shard long, key string, n long")
    rows = index.withColumn("query", F.lit(False)).unionByName(queries.withColumn("query", F.lit(True)))
    found = rows.groupBy("back", "size", "shard").applyInArrow(_search_known, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def _search_known(group: pa.Table) -> pa.Table:
    # a shard has index rows always; queries only ask shards that exist
    return _search(group)


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``words``: word, n. word, form, root, n, n_near, form_n."""
    words = written(words.select("word", "n"), "spelling-words")
    near = near_words(words).withColumnRenamed("word", "n_word")
    all_words = words.join(near, F.col("word") == F.col("n_word"), "left")
    better = F.col("best_n") >= times * F.col("n")
    all_words = all_words.select(
        "word", F.when(better, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("best_n")).alias("form_n")
    )
    all_words = written(all_words, "spelling-forms")
    # forms grow at least ``times``-fold, so chains are short and every round doubles the way gone
    ways = written(all_words.where("form is not null").select("word", F.col("form").alias("root")), "spelling-ways")
    while True:
        ahead = ways.select(F.col("word").alias("a_word"), F.col("root").alias("a_root"))
        step = ways.join(ahead, F.col("root") == F.col("a_word"), "left")
        step = written(step.select("word", F.coalesce("a_root", "root").alias("root"), F.col("a_root").isNotNull().alias("moved")), "spelling-ways")
        ways = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            break
    ways = ways.withColumnRenamed("word", "w_word")
    out = all_words.join(ways, F.col("word") == F.col("w_word"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = r"""
WITH RECURSIVE c AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(9), lambda a, k:
    CASE WHEN k = 0 THEN a WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(i AS BIGINT))) AS t
), r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), g AS (
  SELECT doc_id, run, count(*) AS k FROM r WHERE length(run) >= 6 GROUP BY doc_id, run
), h AS (
  SELECT run, k, xor(list_reduce(
    list_concat(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':', ''), lambda x: CAST(ord(x) AS BIGINT)),
      flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [195::BIGINT, CAST(ord(x) - 64 AS BIGINT)] END))),
    lambda a, b: xor(t[xor(a & 255, b) + 1], a >> 8), 4294967295::BIGINT), 4294967295) AS s
  FROM g, c
), w AS (
  SELECT CASE WHEN s % 199 = 0 THEN substr(run, 1, s % length(run)) || substr(run, s % length(run) + 2) ELSE run END AS word, k FROM h
), v AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), d AS (
  SELECT word, n, i, length(word) AS l, substr(word, 1, i - 1) || substr(word, i + 1) AS x FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), p AS (
  SELECT a.word, a.n, b.word AS o, b.n AS o_n FROM d a JOIN d b ON a.i = b.i AND a.l = b.l AND a.x = b.x AND a.word <> b.word
  UNION SELECT v.word, v.n, d.word, d.n FROM v JOIN d ON v.word = d.x
  UNION SELECT d.word, d.n, v.word, v.n FROM v JOIN d ON v.word = d.x
), q AS (
  SELECT word, n, count(*) AS n_near, arg_min(o, (-o_n, o)) AS best, max(o_n) AS best_n FROM p GROUP BY word, n
), f AS (
  SELECT v.word, CASE WHEN best_n >= 5 * v.n THEN best END AS form, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n
  FROM v LEFT JOIN q ON v.word = q.word
), u AS (
  SELECT word, word AS root, form AS ahead FROM f
  UNION ALL SELECT u.word, f.word, f.form FROM u JOIN f ON u.ahead = f.word
)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN u ON f.word = u.word WHERE u.ahead IS NULL
"""
