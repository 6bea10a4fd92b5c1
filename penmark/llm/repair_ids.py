"""Token ids in binary shards, compressed by a Re-Pair grammar.

Documents are range-partitioned and sorted by doc_id. Each task encodes its
documents with the tokenizers library, appends the end id to each, and writes
shards of at most ``SHARD_TOKENS`` ids, or of one longer document (documents
are never cut). In a shard the
most frequent id pairs are replaced by new symbols, round after round, until
no pair occurs ``MIN_PAIRS`` times or the symbols run out (a round takes counts
once and at most a ``SHARE``-th of the symbols); pairs never span two documents. Symbols stay below 65,536, so they are written in
two bytes.

Shard file (little endian): ``RPG1``, then as uint32 the numbers of base ids,
rules, symbols and documents, then the rules (two uint16 each), each rule's
expansion length (uint32), the symbols (uint16), each document's first symbol
(uint32, and one more for the end), and for every ``MARK``-th symbol the number
of ids before it (uint32). Any range of ids is decoded from the last mark
before it (``read_ids``).

Texts are encoded as ``encoding`` says. Rows are sorted by id and text, so the
bytes of a shard don't depend on the order in which a shuffle brought them;
every attempt of a task writes files under names of its own, which the index
rows of that attempt name.

Defined cases: a null or empty text has only the end id; repeated rows are
documents of their own; null ids come first; an empty table gives no shard
and an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, ship, written
from .encoding import encode
from .files import NewFile, make_folder, open_fs

SHARD_TOKENS = 2_000_000
SHARE = 5
MIN_PAIRS = 16
SYMBOLS = 1 << 16
MARK = 1024
BATCH = 2048
BINS = 20
SHARDS = "part long, seq long, file string, n_docs long, n_ids long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def compress(ids: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (rules, symbols, position of each document's first symbol and
    the end). ``ends`` holds the position after each document."""
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[ends - 1] = True
    rules: list[np.ndarray] = []
    symbol = base
    while symbol < SYMBOLS and len(seq) >= 2:
        key = (seq[:-1] << np.uint32(16)) | seq[1:]
        # exact counts, but only of pairs in bins that reach the least count
        where = (key * np.uint32(2654435761)) >> np.uint32(32 - BINS)
        full = np.bincount(where, minlength=1 << BINS) >= MIN_PAIRS
        at = np.flatnonzero(full[where] & ~last[:-1])
        key = key[at]
        pairs, counts = np.unique(key, return_counts=True)
        room = max(1, (SYMBOLS - base) // SHARE)
        room = room if symbol + 2 * room <= SYMBOLS else SYMBOLS - symbol
        pairs, counts = pairs[counts >= MIN_PAIRS], counts[counts >= MIN_PAIRS]
        if not len(pairs):
            break
        pairs = np.sort(pairs[np.lexsort((pairs, -counts))[:room]])
        # a pair's rule by its bin; where two chosen pairs share a bin, one waits for the next round
        table = np.zeros(1 << BINS, np.int32)
        table[(pairs * np.uint32(2654435761)) >> np.uint32(32 - BINS)] = np.arange(len(pairs))
        slot = table[where[at]]
        hit = pairs[slot] == key
        at, slot = at[hit], slot[hit]
        # in a run of overlapping pairs every second one is replaced
        begins = np.r_[True, np.diff(at) > 1]
        nth = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        at, slot = at[nth % 2 == 0], slot[nth % 2 == 0]
        used, slot = np.unique(slot, return_inverse=True)
        rules.append(np.stack([pairs[used] >> np.uint32(16), pairs[used] & np.uint32(0xFFFF)], 1))
        seq[at] = symbol + slot
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        symbol += len(used)
    firsts = np.r_[0, np.flatnonzero(last) + 1]
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return table.astype(np.uint16), seq.astype(np.uint16), firsts.astype(np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    out = symbols.astype(np.uint16)
    while len(new := np.flatnonzero(out >= base)):
        pair = rules[out[new].astype(np.int32) - base]
        wide = np.empty(len(out) + len(new), np.uint16)
        first = new + np.arange(len(new))  # where each pair lands
        rest = np.ones(len(wide), bool)
        rest[first] = rest[first + 1] = False
        wide[rest] = out[out < base]
        wide[first], wide[first + 1] = pair[:, 0], pair[:, 1]
        out = wide
    return out


def lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids below each rule; a rule uses only ids and earlier rules."""
    n = np.zeros(len(rules), np.int64)
    todo = np.arange(len(rules))
    while len(todo):
        left, right = rules[todo, 0].astype(np.int64), rules[todo, 1].astype(np.int64)
        a = np.where(left < base, 1, n[np.maximum(left - base, 0)])
        b = np.where(right < base, 1, n[np.maximum(right - base, 0)])
        ready = (a > 0) & (b > 0)
        n[todo[ready]] = (a + b)[ready]
        todo = todo[~ready]
    return n.astype(np.uint32)


def pack(ids: np.ndarray, ends: np.ndarray, base: int) -> bytes:
    rules, symbols, firsts = compress(ids, ends, base)
    n = lengths(rules, base)
    each = np.ones(len(symbols), np.int64)
    new = symbols >= base
    each[new] = n[symbols[new].astype(np.int64) - base]
    marks = np.r_[0, np.cumsum(each)][: len(symbols) : MARK]
    head = np.array([base, len(rules), len(symbols), len(ends)], "<u4")
    parts = [head, rules.astype("<u2"), n.astype("<u4"), symbols.astype("<u2"), firsts.astype("<u4"), marks.astype("<u4")]
    return b"RPG1" + b"".join(p.tobytes() for p in parts)


class Shard:
    """A shard's parts; ``data`` are the file's bytes."""

    def __init__(self, data: bytes):
        if data[:4] != b"RPG1":
            raise ValueError("not a token shard")
        self.base, rules, symbols, docs = (int(x) for x in np.frombuffer(data, "<u4", 4, 4))
        at = 20
        parts = []
        for kind, n in (("<u2", 2 * rules), ("<u4", rules), ("<u2", symbols), ("<u4", docs + 1), ("<u4", -(-symbols // MARK))):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        if at != len(data):
            raise ValueError("the shard's length is wrong")
        self.rules, self.n, self.symbols, self.firsts, self.marks = parts[0].reshape(-1, 2), *parts[1:]

    def document(self, k: int) -> np.ndarray:
        return expand(self.symbols[self.firsts[k] : self.firsts[k + 1]], self.rules, self.base)

    def read_ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from the ``start``-th on, without the ids before."""
        if not len(self.symbols):
            return np.zeros(0, np.uint16)
        mark = int(np.searchsorted(self.marks, start, "right")) - 1
        stop = int(np.searchsorted(self.marks, start + count, "left"))
        part = expand(self.symbols[mark * MARK : stop * MARK], self.rules, self.base)
        skip = start - int(self.marks[mark])
        return part[skip : skip + count]


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, vocabulary: int = 50257) -> DataFrame:
    """Write the shards; returns their table: part, seq, file, n_docs, n_ids,
    in doc_id order by (part, seq), and doc_ids of each."""
    spark = docs.sparkSession
    ship(spark)
    folder = make_folder(folder or fresh_path(spark, "token-shards"))
    rows = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, attempt = TaskContext.get().partitionId(), 0, uuid.uuid4().hex
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:06d}-{attempt}.rpg"
            out = NewFile(folder, name)
            out.write(pack(np.concatenate(ids), np.cumsum(np.concatenate(sizes)), vocabulary))
            out.close()
            row = {"part": part, "seq": seq, "file": f"{folder}/{name}", "n_docs": len(names), "n_ids": total, "doc_ids": names}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for first in range(0, batch.num_rows, BATCH):
                some = batch.slice(first, BATCH)
                got, n = encode(tokenizer, some.column("text"))
                got = np.insert(got, np.cumsum(n), end_id)  # behind each document
                named, n = some.column("doc_id").to_pylist(), n + 1
                ends, at = np.cumsum(n), 0
                while at < len(n):
                    # as many documents as the shard has room for, one at least
                    before = int(ends[at - 1]) if at else 0
                    to = int(np.searchsorted(ends, before + SHARD_TOKENS - total, "right"))
                    to = max(to, at + (not names))
                    if to > at:
                        names += named[at:to]
                        ids.append(got[before : ends[to - 1]])
                        sizes.append(n[at:to])
                        total += int(ends[to - 1]) - before
                        at = to
                    if at < len(n):
                        yield flush()
                        names, ids, sizes, total, seq = [], [], [], 0, seq + 1
        if names:
            yield flush()

    return written(rows.mapInArrow(write, SHARDS + ", doc_ids array<long>"), "token-index")


def read_documents(shards: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 of the ids as little-endian uint32."""
    ship(shards.sparkSession)
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    # one slim row per shard of SHARD_TOKENS ids
    firsts = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))
    shards = shards.join(firsts, ["part", "seq"]).select("file", "first", "doc_ids")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = open_fs(row["file"])
                with fs.open_input_file(path) as f:
                    shard = Shard(f.read())
                start, out = row["first"], []
                ids = expand(shard.symbols, shard.rules, shard.base).astype("<u4")
                each = np.ones(len(shard.symbols), np.int64)
                new = shard.symbols >= shard.base
                each[new] = shard.n[shard.symbols[new].astype(np.int64) - shard.base]
                at = np.r_[0, np.cumsum(each)][shard.firsts]
                for k, name in enumerate(row["doc_ids"]):
                    part = ids[at[k] : at[k + 1]]
                    out.append((name, start + int(at[k]), len(part), zlib.crc32(part.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    tasks = max(1, shards.count() // 4)  # a task reads a few shards
    return shards.repartition(tasks, "file").mapInArrow(read, DOCS)
