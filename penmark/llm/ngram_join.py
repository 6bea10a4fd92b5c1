"""N-gram Jaccard self-join with token-combination prefixes.

Documents with the same word sequence form one class, which is a node. A
node's tokens are the 64-bit hashes of its distinct word n-grams. Tokens are
ordered rare first, then by frequency level, then by hash. Rare tokens are
indexed singly; frequent ones in pairs, within sub-classes that bound the
number of pairs. A node's prefix is extended until no set of allowed
differences can hide it: with ``n_c`` prefix tokens in class ``c`` of
combination size ``k_c``, until ``sum(max(0, n_c - k_c + 1))`` exceeds the
number of tokens that a partner may lack. Then linked nodes share at least one
indexed combination, whichever tokens differ. This holds for any common order
and classes, so the frequency levels only have to be the same for all, not
exact: they come from the n-grams that repeat within chunks of the input,
summed over all chunks, and the ``LEVELS_KEPT`` most frequent go into a table
of fixed size.

Links without all pairs: in each index entry the most central node (fewest
earlier prefix tokens) is compared with the others; linked nodes become
components; then only pairs of different components that still share an entry
are compared. Every comparison is exact, on whole sets; pairs that differ in
more token bins than linked sets can are ruled out before, by small sketches of
bin parities. So all linked nodes end in one component, and no link between
different components is lost.

Defined cases: lower-casing is A-Z only; words are runs of characters other
than ASCII white space; a text with fewer than ``n`` words is one n-gram; a
null or wordless text has none and links with nothing; repeated rows are
members of one class; null ids are members, and the component id is the
smallest id that is not null; empty tables give an empty result; other columns
are not read, and are all kept by ``drop_near_duplicates``. Equal n-grams and
word sequences are equal 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written
from .components import components

LEVEL_BITS = 24
LEVELS_KEPT = 1 << 18
FREQUENT = 8
CHUNK = 1 << 20  # n-grams counted together
SMALL = 5  # nodes of fewer than 2**SMALL tokens index frequent tokens singly, too
PAIRS = 6  # about this many prefix tokens a sub-class
BROADCAST_IDS = 1_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def tokens(text: str | None, n: int) -> tuple[int | None, np.ndarray]:
    """(class, sorted distinct n-gram hashes); the class is None without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return None, np.zeros(0, np.uint64)
    node = xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(w))
    gram = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        gram = _mix(gram + w[i : len(w) - size + 1 + i])
    return node, np.unique(gram)


def _levels(counted: DataFrame) -> np.ndarray:
    """Frequency level per hash bin (0: rare), a table of fixed size."""
    top = counted.groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= FREQUENT)
    top = top.orderBy(F.col("times").desc(), "token").limit(LEVELS_KEPT).toArrow()
    out = np.zeros(1 << LEVEL_BITS, np.uint8)
    token = top.column("token").to_numpy().astype(np.int64).view(np.uint64)
    level = np.log2(np.maximum(top.column("times").to_numpy().astype(float), 1)).astype(np.uint8)
    np.maximum.at(out, (token >> np.uint64(64 - LEVEL_BITS)).astype(np.int64), level)
    return out


def _needs(size: int, num: int, den: int) -> int:
    """How many tokens a partner may lack."""
    return size - -(-num * size // den)


def signatures(h: np.ndarray, levels: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, value before its last token) of a node's prefix; value is the
    sum above over the tokens that come earlier."""
    size, spare = len(h), _needs(len(h), num, den)
    level = levels[(h >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)]
    rare = h[level == 0][: spare + 1]
    sigs, values = [_mix(rare)], [np.arange(len(rare))]
    if len(rare) <= spare:
        often = h[level > 0]
        often = often[np.lexsort((often, level[level > 0]))]
        least, most = -(-num * size // den), den * size // num
        for scheme in range(least.bit_length() - 1, most.bit_length()):
            if scheme < SMALL:
                part = often[: spare + 1 - len(rare)]
                sigs.append(_mix(part))
                values.append(len(rare) + np.arange(len(part)))
                continue
            groups = max(1, _needs(1 << scheme, num, den) // PAIRS)
            group = (_mix(often ^ np.uint64(scheme + 1)) % np.uint64(groups)).astype(np.int64)
            # the value grows with every token of a group but its first
            first = np.zeros(len(often), bool)
            first[np.unique(group, return_index=True)[1]] = True
            before = len(rare) + np.r_[0, np.cumsum(~first)[:-1]] if len(often) else np.zeros(0, np.int64)
            inside = before <= spare
            part, group, before = often[inside], group[inside], before[inside]
            order = np.argsort(group, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                i, j = np.triu_indices(len(own), 1)
                if len(i):
                    sigs.append(_mix(_mix(part[own[i]]) + _mix(part[own[j]] + np.uint64(scheme + 1))))
                    values.append(before[own[j]])
    sig, value = np.concatenate(sigs), np.concatenate(values)
    sig, at = np.unique(sig, return_index=True)
    return sig, value[at]


def _read(docs: DataFrame, n: int) -> DataFrame:
    """Rows of documents (doc_id, key: hash of the text, node, size) and,
    without a doc row, of n-grams that repeat in a chunk (token, times)."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("token", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = np.empty(CHUNK, np.uint64), 0, set()

        def count() -> pa.RecordBatch:
            """Tokens that occur again, sorted and compared in place."""
            held[:total].sort()
            again = held[1:total][held[1:total] == held[: max(0, total - 1)]]
            token, times = np.unique(again, return_counts=True)
            none = pa.nulls(len(token), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(token.view(np.int64)), pa.array(times + 1, pa.int64())], schema=schema)

        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                some = batch.slice(first, 1024)
                nodes, sizes = [], []
                for text in some.column("text"):
                    node, h = tokens(text.as_py(), n)
                    nodes.append(node)
                    sizes.append(len(h))
                    if node is not None and node not in seen:
                        if total + len(h) > len(held):
                            yield count()
                            held, total, seen = held if len(h) <= len(held) else np.empty(len(h), np.uint64), 0, set()
                        seen.add(node)
                        held[total : total + len(h)] = h
                        total += len(h)
                none = pa.nulls(len(nodes), pa.int64())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("key"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), none, none], schema=schema)
        if total:
            yield count()

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    return rows.mapInArrow(run, "doc_id long, key long, node long, size long, token long, times long")


def _index(docs: DataFrame, n: int, num: int, den: int, levels: np.ndarray) -> DataFrame:
    """Index entries: sig, node, size, value. Copies met by one task are
    indexed once."""
    held = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                parts = []
                for text in batch.slice(first, 256).column("text"):
                    node, h = tokens(text.as_py(), n)
                    if node is not None and node not in seen:
                        if len(seen) >= CHUNK:
                            seen.clear()
                        seen.add(node)
                        sig, value = signatures(h, held.value, num, den)
                        parts.append((sig.view(np.int64), np.full(len(sig), node), np.full(len(sig), len(h)), value))
                if parts:
                    sig, node, size, value = (np.concatenate(c) for c in zip(*parts))
                    yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node), pa.array(size, pa.int32()), pa.array(value, pa.int32())], names=["sig", "node", "size", "value"])

    return docs.select("text").mapInArrow(run, "sig long, node long, size int, value int")


def _may_link(a: str, b: str, num: int, den: int):
    """Both entries lie in the prefixes that these two sizes call for."""
    least = F.floor((num * (F.col(f"{a}size") + F.col(f"{b}size")) + (num + den - 1)) / F.lit(num + den))
    return (F.col(f"{a}value") <= F.col(f"{a}size") - least) & (F.col(f"{b}value") <= F.col(f"{b}size") - least)


def sketch(h: np.ndarray) -> bytes:
    """Parities of the tokens per bin, about one bit for one to two tokens."""
    bins = 1 << max(6, len(h).bit_length() - 1)
    return np.packbits((np.bincount((h & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1).astype(np.uint8)).tobytes()


def sketches_allow(x: bytes, y: bytes, sizes: int, num: int, den: int) -> bool:
    """False only where the sketches prove that the sets, of ``sizes`` tokens
    together, are not linked: every bin of unequal parity holds a token that
    one of the sets lacks. A longer sketch folds to the shorter one's bins."""
    x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    apart = int(np.bitwise_count(x ^ y).sum())
    return (num + den) * (sizes - apart) >= 2 * num * sizes


def _verify(pairs: DataFrame, docs: DataFrame, homes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are linked, compared on whole sets. Only the
    texts of nodes in pairs are read again, one document of each; whole sets
    are shuffled only for pairs that their sketches don't rule out."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = written(wanted.join(homes, "node").select("node", F.col("doc_id").alias("w_id")), "ngram-wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some, out = batch.slice(first, 256), []
                for want, text in zip(some.column("node").to_pylist(), some.column("text")):
                    node, h = tokens(text.as_py(), n)
                    if node == want:
                        out.append((node, len(h), sketch(h), h.tobytes()))
                if out:
                    node, size, bits, grams = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(bits, pa.binary()), pa.array(grams, pa.binary())],
                        names=["node", "size", "bits", "grams"],
                    )

    def with_both(pairs: DataFrame, found: DataFrame, *named: str) -> DataFrame:
        found = found.select("node", *named).dropDuplicates(["node"])
        for side in ("a", "b"):
            pairs = pairs.join(found.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in named]), side)
        return pairs.select("a", "b", *[f"{side}_{c}" for side in ("a", "b") for c in named])

    found = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id"))).select("node", "text")
    found = written(found.mapInArrow(sets, "node long, size long, bits binary, grams binary"), "ngram-sets")

    def rule_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [x + y for x, y in zip(batch.column("a_size").to_pylist(), batch.column("b_size").to_pylist())]
            keep = [sketches_allow(x.as_py(), y.as_py(), size, num, den) for x, y, size in zip(batch.column("a_bits"), batch.column("b_bits"), sizes)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_grams"), batch.column("b_grams")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(den * shared >= num * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = written(with_both(pairs, found, "size", "bits").mapInArrow(rule_out, "a long, b long"), "ngram-near")
    nodes = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    found = found.join(nodes, "node", "left_semi")
    return written(with_both(near, found, "grams").mapInArrow(compare, "a long, b long"), "ngram-links")


def _groups(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, node, size of every row; node, doc_id, comp of every node)."""
    ship(docs.sparkSession)
    read = written(_read(docs, n), "ngram-read")
    rows = read.where("size IS NOT NULL").select("doc_id", "key", "node", "size")
    # a class's home is one of its documents; minima and counts are combined map-side
    homes = written(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "ngram-homes")
    entries = written(_index(docs, n, num, den, _levels(read.where("token IS NOT NULL"))), "ngram-index")

    # most entries are of one node: those go first, by slim counts
    several = entries.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sig")
    entries = written(entries.join(several, "sig", "left_semi"), "ngram-shared")
    heads = entries.groupBy("sig").agg(F.min(F.struct("value", "node", "size")).alias("h"))
    heads = heads.select("sig", F.col("h.node").alias("h_node"), F.col("h.value").alias("h_value"), F.col("h.size").alias("h_size"))
    shared = entries.join(heads, "sig").where("node <> h_node")
    stars = shared.where(_may_link("", "h_", num, den)).select(F.least("node", "h_node").alias("a"), F.greatest("node", "h_node").alias("b"))
    stars = written(stars.distinct(), "ngram-pairs")
    first = _verify(stars, docs, homes, n, num, den)
    comps = components(first)

    # entries that still join different components
    named = comps.select(F.col("node").alias("c_node"), "comp")
    left = entries.join(named, F.col("node") == F.col("c_node"), "left")
    left = left.select("sig", "node", "size", "value", F.coalesce("comp", "node").alias("comp"))
    left = written(left, "ngram-left")
    open_ = left.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    left = left.join(open_, "sig", "left_semi")
    other = left.select("sig", *[F.col(c).alias(f"o_{c}") for c in ("node", "size", "value", "comp")])
    cross = left.join(other, "sig").where((F.col("comp") < F.col("o_comp")) & _may_link("", "o_", num, den))
    cross = cross.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()
    cross = written(cross.join(stars, ["a", "b"], "left_anti"), "ngram-pairs")
    second = _verify(cross, docs, homes, n, num, den)
    comps = components(first.unionByName(second))

    return rows, homes.join(comps, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp"))


def near_duplicates(docs: DataFrame, n: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id. Linked:
    ``den * intersection >= num * union``."""
    rows, nodes = _groups(docs, n, num, den)
    least = nodes.groupBy("comp").agg(F.min("doc_id").alias("least"))
    nodes = nodes.join(least, "comp").select(F.col("node").alias("m_node"), "least")
    out = rows.join(nodes, F.col("node") == F.col("m_node"), "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each component:
    the one with the smallest doc_id (null last), then the smallest hash of
    its text. A row stays or goes by its own id and text, so null and repeated
    ids are told apart, and of rows equal in both one stays. Rows without
    words all stay."""
    rows, nodes = _groups(docs, n, num, den)
    nodes = nodes.select(F.col("node").alias("m_node"), "comp")
    rows = rows.join(nodes, F.col("node") == F.col("m_node")).groupBy("doc_id", "key", "comp").agg(F.count(F.lit(1)).alias("rows"))
    rows = written(rows, "ngram-rows")
    best = rows.groupBy(F.col("comp").alias("b_comp")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("b"))
    stays = F.col("doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("key") == F.col("b.key"))
    rows = rows.join(best, F.col("comp") == F.col("b_comp")).select(F.col("doc_id").alias("g_id"), F.col("key").alias("g_key"), "rows", stays.alias("stays"))
    rows = written(rows.where("NOT stays OR rows > 1"), "ngram-gone")
    gone, twice = rows.where("NOT stays").select("g_id", "g_key"), rows.where("stays").select("g_id", "g_key")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    same = docs["doc_id"].eqNullSafe(F.col("g_id")) & (F.xxhash64(docs["text"]) == F.col("g_key"))
    kept = docs.join(gone, same, "left_anti")
    if not twice.limit(1).count():
        return kept
    twice = F.broadcast(twice) if twice.count() <= BROADCAST_IDS else twice
    repeated = kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, same, "left_anti").unionByName(repeated)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""
