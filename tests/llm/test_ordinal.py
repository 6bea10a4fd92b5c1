import random

import numpy as np
import pyarrow as pa

from penmark.llm import ordinal

SF = "/root/testdata/sf0.1"


def texts():
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(900):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        if i % 3 == 0:
            base = [w + "%%%" for w in base]
        elif i % 3 == 1:
            base += rng.sample([f"bad{k}" for k in range(8)], 4)
            rng.shuffle(base)
        rows.append((i, " ".join(base), i % 3))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1, False) for d, t, _ in rows], "doc_id long, text string, grade string, p_tail int, kept boolean")
    labels = spark.createDataFrame([(d, int(g > 0), int(g == 1)) for d, _, g in rows if d is not None and d % 2], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out(spark):
    rows = texts()
    docs, labels = frames(spark, rows)
    model = ordinal.fit(docs, labels)
    assert (np.diff(model.cuts) > 0).all()
    got = {r.doc_id: r for r in ordinal.score(docs, model).collect()}
    wrong = [d for d, _, g in rows if d % 2 == 0 and got[d].kept != (g == 2)]
    assert len(wrong) <= 9
    mean = [np.mean([got[d].expected_grade for d, _, g in rows if g == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]
    kept = ordinal.select_good(docs, model)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept}
    again = ordinal.fit(docs.repartition(3), labels.repartition(2))
    assert {r.doc_id: r.kept for r in ordinal.score(docs, again).collect()} == {d: r.kept for d, r in got.items()}


def test_held_out_on_the_tables(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = ordinal.fit(docs, labels.where("doc_id % 4 <> 0"))
    rest = ordinal.score(docs.where("doc_id % 4 = 0"), model).join(labels, "doc_id").collect()
    good = [r.kept for r in rest if r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in rest if r.quality == 0 or r.toxic == 1]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_odd_rows(spark):
    rows = [*texts()[:60], (1000, None, 2), (1001, "", 2), (1002, "x " * 100_000, 2), (3, "word1", 0), (None, "word2", 2)]
    docs, labels = frames(spark, rows)
    more = labels.unionByName(spark.createDataFrame([(1, None, 1), (None, 1, 1)], labels.schema))
    assert ordinal.score(docs, ordinal.fit(docs, more)).count() == len(rows)
    assert ordinal.fit(docs, labels.limit(0)) is None and ordinal.fit(docs.limit(0), labels) is None
    assert all(r.kept for r in ordinal.score(docs, None).collect())
    assert ordinal.score(docs.limit(0), None).count() == 0 and ordinal.select_good(docs.limit(0), None).count() == 0
    at, n = ordinal.features(pa.array(["A a b", None, ""]))
    assert n.tolist() == [5, 4, 4] and len(at) == 13
