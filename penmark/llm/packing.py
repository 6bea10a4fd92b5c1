"""Packing of token sequences by non-negative least squares.

Documents become ids (the tokenizers library, an end id behind each), written
once as a table. A document gives whole windows of ``WINDOW`` ids and one rest.
The histogram of the rests' lengths is at most ``WINDOW - 1`` numbers, however
many documents there are; for it, all combinations of two and three lengths
that fill a window are enumerated, the repeat counts that come nearest to the
histogram are found by non-negative least squares (accelerated projected
gradient), rounded to what the histogram holds, and written down as ranges of
ranks: the k-th rest of a length has its window and place by arithmetic. A
rest's rank is the sum of its rank in its file and of the counts of the files
before, so nothing is sorted or gathered. What the combinations leave, by
length, forms one stream that is cut every ``WINDOW`` ids; its last part is cut
into powers of two, which need no padding. So only these cuts and those of the
long documents go through documents, and no id is left out or padded.

Defined cases: a null or empty text has only the end id; repeated rows and
rows of equal or null ids are documents of their own; any length may hold all
documents; texts of any length are cut; an empty table gives an empty result;
other columns are not read. Which of two documents of one length goes where
depends on the files of the token table, the windows' fill does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written
from .encoding import encode

WINDOW = 1024
SLICE = 1024
STEPS = 400
BROADCAST_ROWS = 500_000
TOKENS = "part long, doc_id long, n long, rank long, windows long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """The token table: part (the task that wrote a row), doc_id, n (ids with
    the end id), the rank of its rest among the part's rests of that length,
    the number of whole windows before it in the part, ids (uint16)."""
    ship(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(window, np.int64)
        full = 0
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                some = batch.slice(first, SLICE)
                ids, n = encode(tokenizer, some.column("text"))
                ids = np.insert(ids, np.cumsum(n), end_id).astype("<u2")
                n = n + 1
                rest = n % window
                order = np.argsort(rest, kind="stable")
                heads = np.searchsorted(rest[order], rest[order], "left")
                rank = np.empty(len(n), np.int64)
                rank[order] = np.arange(len(n)) - heads
                rank += seen[rest]
                seen += np.bincount(rest, minlength=window)
                whole = n // window
                before = full + np.cumsum(whole) - whole
                full += int(whole.sum())
                offsets = np.r_[0, np.cumsum(n) * 2].astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                parts = [pa.array(np.full(len(n), part, np.int64)), some.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n, rank, before)), blob]
                yield pa.RecordBatch.from_arrays(parts, names=["part", "doc_id", "n", "rank", "windows", "ids"])

    return written(docs.select("doc_id", "text").mapInArrow(write, TOKENS), "tokens")


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All multisets of two or three of the given lengths that fill a window:
    rows of three ascending numbers, 0 for none."""
    known = np.zeros(window + 1, bool)
    known[lengths] = True
    known[[0, window]] = False
    small = np.flatnonzero(known)
    two = small[known[window - small] & (small <= window - small)]
    rows = [np.stack([np.zeros_like(two), two, window - two], 1)]
    for a in small[small <= window // 3]:
        b = small[(small >= a) & (small <= (window - a) // 2)]
        b = b[known[window - a - b]]
        rows.append(np.stack([np.full_like(b, a), b, window - a - b], 1))
    return np.concatenate(rows)


def least_squares(combos: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|, A having a combination's
    lengths in its columns (accelerated projected gradient)."""
    wide = len(histogram)
    flat = combos.ravel()
    valid = (combos > 0).astype(float)

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, (valid * x[:, None]).ravel(), wide)

    def back(y: np.ndarray) -> np.ndarray:
        return (y[combos] * valid).sum(1)

    v = np.ones(len(combos))
    bound = 1.0
    for _ in range(20):  # the largest eigenvalue, for the step
        v = back(times(v))
        bound = float(np.linalg.norm(v))
        v /= bound
    target = histogram.astype(float)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - back(times(y) - target) / (1.02 * bound), 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def solve(histogram: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(combinations, how often each is taken): never more of a length than
    the histogram (of the lengths 0 to ``window - 1``) holds."""
    left = histogram.copy()
    left[0] = 0
    combos = combinations(np.flatnonzero(left), window)
    if not len(combos):
        return combos, np.zeros(0, np.int64)
    x = least_squares(combos, left)
    taken = np.zeros(len(combos), np.int64)
    floor, more = np.floor(x).astype(np.int64), x - np.floor(x)
    order = np.lexsort((np.arange(len(x)), -x))
    order = order[floor[order] > 0]
    # whole counts first, then single ones by the size of their fraction
    for sweep, wanted in ((order, floor), (np.lexsort((np.arange(len(x)), -more)), np.ones(len(x), np.int64))):
        for p in sweep.tolist():
            parts = [int(q) for q in combos[p] if q]
            n = min(int(wanted[p]), *(int(left[q]) // parts.count(q) for q in parts))
            if n > 0:
                taken[p] += n
                for q in parts:
                    left[q] -= n
    used = taken > 0
    return combos[used], taken[used]


class Plan:
    """Where the k-th rest of each length goes, as plain arrays."""

    def __init__(self, histogram: np.ndarray, whole: int, window: int = WINDOW):
        combos, taken = solve(histogram, window)
        self.window, self.whole = window, whole
        base = whole + np.cumsum(taken) - taken
        used = np.zeros(window, np.int64)
        starts, first, places = [], [], []
        for combo, n, at in zip(combos.tolist(), taken.tolist(), base.tolist()):
            place = 0
            for q in combo:
                if q:
                    starts.append((q, int(used[q])))
                    first.append(at)
                    places.append(place)
                    used[q] += n
                    place += q
        order = sorted(range(len(starts)), key=starts.__getitem__)
        self.rest = np.array([starts[i][0] for i in order], np.int64)
        self.rank = np.array([starts[i][1] for i in order], np.int64)
        self.sequence = np.array([first[i] for i in order], np.int64)
        self.offset = np.array([places[i] for i in order], np.int64)
        self.begin = np.searchsorted(self.rest, np.arange(window + 1))
        self.used = used
        spare = (histogram - used) * np.arange(window)
        spare[0] = 0
        self.stream = np.r_[0, np.cumsum(spare)]  # the stream's position at each length
        self.after = whole + int(taken.sum())
        self.total = int(self.stream[-1])
        tail = self.total // window * window
        bits = [b for b in (1 << np.arange(40)[::-1]).tolist() if (self.total - tail) & b]
        self.tails = tail + np.r_[0, np.cumsum(bits)].astype(np.int64)

    def place(self, rest: int, rank: int) -> list[tuple[int, int, int]]:
        """(length, sequence, offset) of the parts of a rest."""
        if rank < self.used[rest]:
            a, b = self.begin[rest], self.begin[rest + 1]
            i = a + int(np.searchsorted(self.rank[a:b], rank, "right")) - 1
            return [(rest, int(self.sequence[i] + rank - self.rank[i]), int(self.offset[i]))]
        at = int(self.stream[rest] + (rank - self.used[rest]) * rest)
        out = []
        while rest:
            if at < self.tails[0]:
                sequence, offset = divmod(at, self.window)
                n = min(rest, self.window - offset)
            else:
                k = int(np.searchsorted(self.tails, at, "right")) - 1
                sequence, offset = int(self.tails[0]) // self.window + k, at - int(self.tails[k])
                n = min(rest, int(self.tails[k + 1]) - at)
            out.append((n, self.after + sequence, offset))
            at, rest = at + n, rest - n
        return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids
    (little-endian uint32)."""
    spark = docs.sparkSession
    table = tokens(docs, tokenizer, end_id, window)
    rest = (F.col("n") % window).cast("int")
    counts = written(table.groupBy("part", rest.alias("rest")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("n") / window)).alias("whole")), "rests")
    # at most ``window`` rows, whatever the number of documents
    sums = counts.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole")).collect()
    histogram = np.zeros(window, np.int64)
    for r in sums:
        histogram[r.rest] = r.n
    plan = Plan(histogram, sum(r.whole for r in sums), window)
    shared = spark.sparkContext.broadcast(plan)  # bounded by the number of combinations

    # what lies before each part: one window per length over the parts' counts
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one slim row per part
    wholes = counts.groupBy("part").agg(F.sum("whole").alias("whole")).select("part", F.coalesce(F.sum("whole").over(order), F.lit(0)).alias("base"))
    firsts = ranks.unionByName(wholes.select("part", F.lit(-1).alias("rest"), "base"))
    firsts = firsts.groupBy(F.col("part").alias("f_part")).agg(F.map_from_entries(F.collect_list(F.struct("rest", "base"))).alias("bases"))
    if counts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    rows = table.join(firsts, F.col("part") == F.col("f_part"))
    rows = rows.select("doc_id", "n", (F.col("rank") + F.element_at("bases", rest)).alias("rank"), (F.col("windows") + F.element_at("bases", F.lit(-1))).alias("windows"), "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                some = batch.slice(first, SLICE)
                names, n, rank, windows = (some.column(c).to_pylist() for c in ("doc_id", "n", "rank", "windows"))
                out: list[tuple] = []
                for name, size, k, full in zip(names, n, rank, windows):
                    at = 0
                    for i in range(size // window):
                        out.append((name, at, window, size, full + i, 0))
                        at += window
                    if at < size:
                        for length, sequence, offset in plan.place(size - at, k):
                            out.append((name, at, length, size, sequence, offset))
                            at += length
                ids = np.frombuffer(b"".join(some.column("ids").to_pylist()), "<u2").astype("<u4")
                columns = list(zip(*out))
                offsets = np.r_[0, np.cumsum(columns[2]) * 4].astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), blob], names=[c.split()[0] for c in PIECES.split(", ")])

    return rows.mapInArrow(cut, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length, ids (little-endian uint32) and the pieces in it."""
    row = F.struct("offset", "doc_id", "start", "length", "ids")
    # a sequence has at most a window's ids, so as many pieces
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(row)).alias("pieces"))
    ids = F.aggregate("pieces", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return rows.select("sequence_id", "length", ids.alias("ids"), F.transform("pieces", lambda p: p.dropFields("ids")).alias("pieces"))


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a check sum for their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
