"""Quality classifier: cumulative-link (ordinal) regression on graded ratings.

Grades: 0 for documents rated of no quality, 1 for toxic ones, 2 for the
rest. All grades share one weight vector over hashed text features, and
ordered thresholds cut its score: ``P(grade <= k) = logistic(t_k - score)``.
The result gives the expected grade and the tail probability ``P(grade >= 2)``;
a document is kept when the tail probability reaches ``KEEP``.

Features of a text: its distinct lower-cased words, the first four letters of
longer words, and three shape marks (how often words repeat, how much is upper
case, how much is neither letter, digit nor space), hashed to ``BUCKETS``.
Each counts once, scaled by how far its share of the documents of a lower
grade is from its share of the highest one (log-ratio less ``FLOOR``; 0 for
buckets in few rated documents), over the fourth root of their number.

Fit: on at most about ``SAMPLE`` labelled documents, a documented bound: all
when there are fewer, else those whose id hash falls under the share. Their
features are written once; every round each of ``PARTS`` tasks passes over its
share from the common weights (AdaGrad steps), and the weights are averaged.
The driver holds one weight vector per task, of fixed size. Scoring reads
every document whole.

Defined cases: a null or empty text has one empty word and its shape marks; label rows with
a null are not used; a document with several ratings has the lowest; without
any label, or with one grade only, every document is kept (probability 1);
repeated rows are scored alike; empty tables give an empty result; columns
other than those named are not read, and are all kept by ``select_good``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written

BUCKETS = 1 << 20
SAMPLE = 20_000
PARTS = 4
ROUNDS = 10
PASSES = 2
STEP = 0.3
MIN_SHARE = 0.001  # of the rated documents that a bucket is in, and at least
MIN_DOCS = 3
SMOOTHING = 2.0
FLOOR = 1.5
KEEP = 0.7
GRADES = 3
BATCH = 512


@dataclass
class Model:
    weights: np.ndarray  # float32, BUCKETS
    cuts: np.ndarray  # ordered, GRADES - 1


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) & (BUCKETS - 1)


def _shape(text: str, words: int, distinct: int) -> list[int]:
    letters = max(1, len(text))
    upper = len(text) - len(text.translate(_NO_UPPER))
    signs = len(text.translate(_ONLY_SIGNS))
    marks = (min(9, 10 * distinct // max(1, words)), min(9, 20 * upper // letters), min(9, 20 * signs // letters))
    return [_bucket(f"\x00{k}:{m}") for k, m in enumerate(marks)]


class _Signs(dict):
    """For str.translate: drops letters, digits and white space."""

    def __missing__(self, c: int):
        self[c] = kept = None if chr(c).isalnum() or chr(c).isspace() else c
        return kept


class _Uppers(dict):
    def __missing__(self, c: int):
        self[c] = kept = None if chr(c).isupper() else c
        return kept


_ONLY_SIGNS, _NO_UPPER = _Signs(), _Uppers()


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts in one array, and how many each text has."""
    texts = pc.fill_null(texts, "")
    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts)))
    coded = words.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    head = np.array([_bucket(n) for n in names], np.int64).reshape(-1)
    # words that share their first letters share a mark; -1: too short
    front = np.array([_bucket("\x01" + n[:4]) if len(n) > 4 else -1 for n in names], np.int64).reshape(-1)
    sizes = np.diff(words.offsets.to_numpy())
    doc = np.repeat(np.arange(len(texts)), sizes)
    index = coded.indices.to_numpy()
    pairs = np.unique(doc * max(1, len(names)) + index)
    doc, index = pairs // max(1, len(names)), pairs % max(1, len(names))
    distinct = np.bincount(doc, minlength=len(texts))
    marks = np.array([_shape(t, int(n), int(d)) for t, n, d in zip(texts.to_pylist(), sizes, distinct)], np.int64).reshape(-1, 3)
    fronts = front[index]
    keys = np.concatenate([
        doc * BUCKETS + head[index] if len(index) else np.zeros(0, np.int64),
        (doc * BUCKETS + fronts)[fronts >= 0],
        (np.arange(len(texts))[:, None] * BUCKETS + marks).ravel(),
    ])
    keys = np.unique(keys)
    return (keys & (BUCKETS - 1)).astype(np.int32), np.bincount(keys >> (BUCKETS.bit_length() - 1), minlength=len(texts))


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def scales(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Per bucket, from the documents of each grade that it is in: the largest
    log-ratio of a lower grade's share to the highest one's, less FLOOR."""
    share = (counts + SMOOTHING) / (totals[:, None] + 2 * SMOOTHING)
    far = np.abs(np.log(share[:-1] / share[-1])).max(0) - FLOOR
    far[counts.sum(0) < max(MIN_DOCS, MIN_SHARE * totals.sum())] = 0
    return np.maximum(far, 0).astype(np.float32)


def passes(weights: np.ndarray, scale: np.ndarray, cuts: np.ndarray, docs: list[tuple[int, np.ndarray, int]], n: int, seed: int) -> None:
    """AdaGrad passes over (grade, buckets, number of all buckets) in a fixed
    random order; changes the weights and cuts in place."""
    seen = np.ones(len(weights), np.float32)
    rng = np.random.default_rng(seed)
    for _ in range(n):
        for i in rng.permutation(len(docs)):
            grade, at, size = docs[i]
            x = scale[at] * size**-0.25
            score = float(weights[at] @ x)
            below = _logistic(cuts[grade - 1] - score) if grade else 0.0
            upto = _logistic(cuts[grade] - score) if grade < len(cuts) else 1.0
            slope = 1 - upto - below
            if abs(slope) > 1e-4:
                step = slope * x
                seen[at] += step * step
                weights[at] -= STEP * step / np.sqrt(seen[at])
            p = max(upto - below, 1e-9)
            if grade < len(cuts):
                cuts[grade] += 0.02 * upto * (1 - upto) / p
            if grade:
                cuts[grade - 1] -= 0.02 * below * (1 - below) / p
            for k in range(1, len(cuts)):
                cuts[k] = max(cuts[k], cuts[k - 1] + 0.1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    spark = docs.sparkSession
    ship(spark)
    rated = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    grade = F.when(F.col("quality") <= 0, 0).when(F.col("toxic") > 0, 1).otherwise(2)
    rated = rated.groupBy("doc_id").agg(F.min(grade).cast("int").alias("grade"))
    rated = written(rated.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "ordinal-labels")
    counts = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}  # GRADES rows
    if len(counts) < 2:
        return None
    share = min(1.0, sample / sum(counts.values()))
    chosen = rated.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    # about SAMPLE rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH):
                some = batch.slice(first, BATCH)
                at, n = features(some.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("grade"), lists], names=["doc_id", "grade", "at"])

    dealt = rows.mapInArrow(derive, "doc_id long, grade int, at array<int>")
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(PARTS)).cast("int")
    dealt = written(dealt.withColumn("part", part).repartition(PARTS, "part"), "ordinal-features")
    dealt = dealt.repartition(PARTS, "part").sortWithinPartitions("part", "doc_id", "grade", F.xxhash64("at"))

    # one row per grade, and one per bucket that enough rated documents are in
    total = {r["grade"]: r["count"] for r in dealt.groupBy("grade").count().collect()}
    totals = np.array([total.get(g, 0) for g in range(GRADES)], np.int64)
    found = dealt.select("grade", F.explode("at").alias("bucket")).groupBy("bucket")
    found = found.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("grade") == g).alias(f"n{g}") for g in range(GRADES)])
    found = found.where(F.col("n") >= max(MIN_DOCS, MIN_SHARE * float(totals.sum()))).orderBy("bucket").toArrow()
    scale = scales(np.array([found.column(f"n{g}").to_numpy() for g in range(GRADES)]), totals)
    # only buckets that say something about the grade take part
    active, scale = found.column("bucket").to_numpy()[scale > 0], scale[scale > 0]
    weights, cuts = np.zeros(len(active), np.float32), np.linspace(-2.0, 2.0, GRADES - 1)
    for turn in range(ROUNDS):
        held = spark.sparkContext.broadcast((active, weights, scale, cuts))

        def train(batches: Iterator[pa.RecordBatch], held=held, turn=turn) -> Iterator[pa.RecordBatch]:
            active, w, scale, c = held.value
            w, c, docs = w.copy(), c.copy(), []
            for batch in batches:
                for grade, at in zip(batch.column("grade").to_pylist(), batch.column("at")):
                    at = at.values.to_numpy()
                    docs.append((grade, np.searchsorted(active, at[np.isin(at, active, assume_unique=True)]), len(at)))
            if docs:
                passes(w, scale, c, docs, PASSES, turn)
                yield pa.RecordBatch.from_pylist([{"n": len(docs), "w": w.tobytes(), "c": c.tobytes()}])

        # PARTS rows, of at most BUCKETS weights each
        got = sorted(dealt.mapInArrow(train, "n long, w binary, c binary").collect())
        seen = sum(r.n for r in got)
        weights = sum(np.frombuffer(r.w, np.float32) * np.float32(r.n / seen) for r in got)
        cuts = sum(np.frombuffer(r.c) * (r.n / seen) for r in got)
        held.destroy()
    whole = np.zeros(BUCKETS, np.float32)
    whole[active] = weights * scale
    return Model(whole, cuts)


SCORE = "doc_id long, expected_grade double, p_tail double, kept boolean"


def _judge(model: Model | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and tail probability."""
    if model is None:
        return np.full(len(texts), GRADES - 1.0), np.ones(len(texts))
    at, n = features(texts)
    sums = np.add.reduceat(model.weights[at].astype(np.float64), np.r_[0, np.cumsum(n)[:-1]]) if len(texts) else np.zeros(0)
    score = np.round(sums / n**0.25, 6)
    above = 1 - _logistic(model.cuts[None, :] - score[:, None])
    return above.sum(1), above[:, -1]


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, expected_grade, p_tail, kept."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH):
                some = batch.slice(first, BATCH)
                expected, tail = _judge(held.value, some.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(expected), pa.array(tail), pa.array(tail >= KEEP)],
                    names=["doc_id", "expected_grade", "p_tail", "kept"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCORE)


def select_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, all columns, that the model keeps. The rows are
    judged where they are read; nothing is shuffled."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH):
                some = batch.slice(first, BATCH)
                yield some.filter(pa.array(_judge(held.value, some.column("text"))[1] >= KEEP))

    return docs.mapInArrow(run, docs.schema)
