
import random

from pyspark.sql import functions as F

from penmark.operators import kmeans

FE = kmeans.FEATS


def _points(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = 0.0 if i % 3 else 6.0
        rows.append((i, *[base + rng.choice([0.0, 0.0, 1.0, 2.0]) + (rng.random() if j < 2 else 0.0) for j in range(15)]))
    return spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{f} double" for f in FE))


def test_fit_properties(spark):
    feats = _points(spark)
    pts = kmeans.compact(feats).cache()
    res = kmeans.fit_points(pts, k=2, runs=4, seed=11)
    c = res.centroids
    # every row sits with its nearest centre, every centre is its members' mean
    lab = kmeans.predict(feats, c)
    means = {r["cluster"]: r for r in lab.groupBy("cluster").agg(*[F.avg(f).alias(f) for f in FE]).collect()}
    if not res.converged:
        return
    for j in range(2):
        if j in means:
            assert max(abs(means[j][f] - c[j][i]) for i, f in enumerate(FE)) < 1e-3
    assert all(res.inertia <= r["inertia"] + 1e-12 for r in res.runs)


def test_same_model_at_any_partitioning(spark):
    feats = _points(spark)
    models = []
    for n in (1, 2, 8):
        pts = kmeans.compact(feats.repartition(n)).repartition(n)
        models.append(kmeans.fit_points(pts, k=2, runs=3, seed=5).centroids)
    for m in models[1:]:
        for a, b in zip(m, models[0]):
            assert max(abs(x - y) for x, y in zip(a, b)) < 1e-9


def test_compaction_matches_rows(spark):
    feats = _points(spark, 300)
    pts = kmeans.compact(feats)
    assert pts.agg(F.sum("w")).collect()[0][0] == 300
    init = [[0.0] * 15, [6.0] * 15]
    c_compact, _ = kmeans.fixed_rounds(pts, init, 3)
    # plain per-row Lloyd with literal centres
    cur = init
    for _ in range(3):
        lab = kmeans.predict(feats, cur)
        agg = {r["cluster"]: r for r in lab.groupBy("cluster").agg(*[F.avg(f).alias(f) for f in FE]).collect()}
        cur = [[agg[j][f] for f in FE] if j in agg else cur[j] for j in range(2)]
    for a, b in zip(c_compact, cur):
        assert max(abs(x - y) for x, y in zip(a, b)) < 1e-9


def test_empty_input_fails(spark):
    import pytest

    from penmark.plans import pipeline

    df = spark.createDataFrame([], "doc_id long, text string")
    with pytest.raises(ValueError):
        pipeline.train(df, ["doc_id"])
