"""The whole fit against plain Python, and the model table with its weights and phrase lists."""

import hashlib
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from penmark.functions import lexicon
from penmark.operators import kmeans, scoring
from penmark.plans import pipeline
from penmark.sources.model_io import VERSION, Model, load_model, save_model

DIM = 15
FE = kmeans.FEATS
TEXTS = [
    (1, "plain words here. And more words."),
    (2, "Label: one\nOther label: two"),
    (3, "🚀🚀 we leverage – robust – things 🎉"),
    (4, None),
    (5, "🚀 shipped it 🚀 – – “quoted”"),
    (6, "nothing to see"),
    (7, None),
    (8, "zorp zorp zorp"),
]


def _docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def _dist(a, b):
    return max(abs(x - y) for x, y in zip(a, b))


def _u(point, run, j, seed):
    parts = [str(math.floor(v * 1e6 + 0.5)) for v in point] + [str(run), str(j), str(seed)]
    return (int(hashlib.md5(",".join(parts).encode()).hexdigest()[:13], 16) + 1) / 2.0**52


def _plain_fit(points, k, runs, seed, tol=1e-4, max_iter=100):
    """(inertia rounded, run, n_iter, centres) of the best run; points: {vector: weight}."""
    found = []
    for run in range(runs):
        centres = []
        for j in range(k):
            best = None
            for p, w in points.items():
                weight = w if j == 0 else w * min(_dist(p, c) for c in centres)
                if weight > 0:
                    best = min(x for x in (best, (-math.log(_u(p, run, j, seed)) / weight, p)) if x is not None)
            centres.append(best[1] if best else centres[-1])
        for n in range(1, max_iter + 1):
            groups = [[] for _ in range(k)]
            for p, w in points.items():
                ds = [_dist(p, c) for c in centres]
                groups[ds.index(min(ds))].append((p, w))
            new = [
                tuple(sum(p[i] * w for p, w in g) / sum(w for _, w in g) for i in range(DIM)) if g else c
                for g, c in zip(groups, centres)
            ]
            moved = max(_dist(a, b) for a, b in zip(centres, new))
            centres = new
            if moved < tol:
                break
        total = sum(points.values())
        inertia = sum(min(_dist(p, c) for c in centres) * w for p, w in points.items()) / total
        found.append((round(inertia, 9), run, n, centres))
    return min(found, key=lambda f: f[:2])


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_fit_equals_plain_python(spark, k):
    rng = random.Random(k)
    points = {}
    for _ in range(60):
        p = tuple(rng.choice([0.0, 0.0, 1.0, 2.5]) + (rng.random() * 4 if i < 2 else 0.0) for i in range(DIM))
        points[p] = points.get(p, 0) + rng.choice([1.0, 1.0, 7.0, 90.0])
    rows = [(*p, w) for p, w in points.items()]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in FE) + ", w double").repartition(3)
    got = kmeans.fit_points(df, k=k, runs=4, seed=99, max_iter=100)
    inertia, run, n_iter, centres = _plain_fit(points, k, 4, 99)
    assert (got.run, got.n_iter) == (run, n_iter)
    assert abs(got.inertia - inertia) < 1e-8
    assert all(_dist(a, b) < 1e-9 for a, b in zip(got.centroids, centres))


def test_fewer_points_than_centres(spark):
    df = spark.createDataFrame([(*[1.0] * DIM, 5.0)], ", ".join(f"{f} double" for f in FE) + ", w double")
    got = kmeans.fit_points(df, k=3, runs=2, seed=1)
    assert got.centroids == [[1.0] * DIM] * 3 and got.inertia == 0.0


def test_null_texts_are_counted_not_hidden(spark):
    res = pipeline.train(_docs(spark), ["doc_id"], runs=2)
    row = pipeline.training_report(res, "2025-08-09").collect()[0]
    assert res.n_null == 2 and row["n_null"] == 2
    assert int(row["ai"]) + int(row["human"]) == 6
    whole = pipeline.train(_docs(spark).where("text is not null"), ["doc_id"], runs=2)
    assert whole.n_null == 0 and whole.model == res.model


def test_model_keeps_weights_and_lexicons(spark, tmpdir_fresh):
    own, phrases = {"emoji_rate": 0.0, "labels": 7.0}, {"devlog": ["zorp"]}
    res = pipeline.train(_docs(spark), ["doc_id"], runs=3, weights=own, lexicons=phrases)
    by = {m: w for (m, _), w in zip(lexicon.FEATURE_WEIGHTS, res.model.weights)}
    assert by["emoji_rate"] == 0.0 and by["labels"] == 7.0 and by["hashtags"] == dict(lexicon.FEATURE_WEIGHTS)["hashtags"]
    path = os.path.join(tmpdir_fresh, "model")
    save_model(res.model, spark, path)
    back = load_model(spark, path)
    assert back == res.model
    raw = spark.read.parquet(path)
    assert {r["version"] for r in raw.collect()} == {VERSION}
    assert raw.where("lexicons is not null").count() == 1  # the lists once, however many clusters
    # the scores are those of the training features
    fitted = scoring.score_features(res.features, back.centroids, back.ai_cluster, ["doc_id"])
    loaded = scoring.score(_docs(spark), back, keep=["doc_id"], with_metrics=True)
    want = {r["doc_id"]: r["chance_ai"] for r in fitted.collect()}
    got = {r["doc_id"]: r for r in loaded.collect()}
    assert {d: r["chance_ai"] for d, r in got.items() if r["chance_ai"] is not None} == want
    assert got[8]["metrics"]["devlog_count"] == 3.0 and got[4]["verdict"] is None
    # and not those of the fixed weights
    other = pipeline.train(_docs(spark), ["doc_id"], runs=3)
    assert other.model.centroids != res.model.centroids


def test_names_by_raw_rate_at_any_emoji_weight(spark):
    """An emoji weight of 0 takes the rate out of the features, not out of the naming."""
    for w in (0.0, 0.5, 2.0):
        res = pipeline.train(_docs(spark), ["doc_id"], runs=3, weights={"emoji_rate": w})
        labelled = pipeline.in_sample(res)
        mean = {r["cluster"]: r["m"] for r in labelled.groupBy("cluster").agg(F.avg("emoji_rate").alias("m")).collect()}
        assert res.model.ai_cluster == max(mean, key=lambda c: (mean[c], c))
        for st in res.stats:
            assert abs(st["emoji_mean"] - mean.get(st["cluster"], 0.0)) < 1e-12


def test_older_tables_are_read_newer_ones_refused(spark, tmpdir_fresh):
    model = Model([[0.0] * DIM, [1.0] * DIM], 1, 0.5, 3, True, 0)
    old = os.path.join(tmpdir_fresh, "v1")
    model.to_frame(spark).drop("version", "weights", "lexicons", "lexicon_digest").coalesce(1).write.parquet(old)
    back = load_model(spark, old)
    assert back == model and back.weights is None and back.lexicon_digest is None
    assert scoring.score(_docs(spark), back, keep=["doc_id"]).count() == len(TEXTS)
    for name, column, value in (("new", "version", F.lit(VERSION + 1)), ("mixed", "lexicon_digest", F.col("cluster").cast("string"))):
        path = os.path.join(tmpdir_fresh, name)
        model.to_frame(spark).withColumn(column, value).write.parquet(path)
        with pytest.raises(ValueError):
            load_model(spark, path)


def test_other_phrase_lists_are_refused(spark, tmpdir_fresh, monkeypatch):
    model = Model([[0.0] * DIM, [1.0] * DIM], 1)
    path = os.path.join(tmpdir_fresh, "model")
    save_model(model, spark, path)
    back = load_model(spark, path)
    scoring.score(_docs(spark), back, keep=["doc_id"])
    monkeypatch.setitem(lexicon.FAMILIES, "devlog", ["something else"])
    with pytest.raises(ValueError, match="phrase lists"):
        scoring.score(_docs(spark), back, keep=["doc_id"])
    # a model that holds its own list of that family doesn't depend on the built-in one
    own = Model(model.centroids, 1, lexicons={"devlog": ["x"]}, lexicon_digest=lexicon.digest({"devlog": ["x"]}))
    monkeypatch.setitem(lexicon.FAMILIES, "devlog", ["a third"])
    scoring.score(_docs(spark), own, keep=["doc_id"])


def test_digest_follows_what_counts():
    base = lexicon.digest()
    assert base == lexicon.digest({}) == lexicon.digest({"devlog": list(reversed(lexicon.FAMILIES["devlog"])) * 2})
    assert base != lexicon.digest({"devlog": ["x"]}) != lexicon.digest({"devlog": ["x", "y"]})
    assert json.loads(json.dumps(base)) == base and len(base) == 64


@pytest.mark.parametrize("bad", [{"no such metric": 1.0}, [1.0] * 14, [0.0] * 15, [-1.0] + [1.0] * 14, [math.nan] + [1.0] * 14])
def test_bad_weights(spark, bad):
    with pytest.raises(ValueError):
        pipeline.train(_docs(spark), ["doc_id"], weights=bad)
