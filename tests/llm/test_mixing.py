from collections import Counter

from penmark.llm import mixing

SCHEMA = "doc_id long, text string, source string, rate int, _copies int"


def rows(spark):
    data = [(i, "w " * (i % 7 + 1), "ab"[i % 2] if i % 5 else None, i, i) for i in range(60)]
    return spark.createDataFrame([*data, data[1], (60, None, "c", 0, 0), (61, "", "c", 0, 0), (None, "x y", "a", 0, 0)], SCHEMA)


def test_targets_and_copies(spark):
    got = mixing.plan(rows(spark)).collect()
    assert len(got) == 64
    total = sum(r.size for r in got)
    targets = {(r.source_size, r.target) for r in got}
    assert abs(sum(t for _, t in targets) - 1.5 * total) < 1e-6
    assert all(t <= 2 * s for s, t in targets) and all(r.taken <= 2 * r.size for r in got)
    assert all(r.size == 0 and r.taken == 0 for r in got if r.doc_id in (60, 61))
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.plan(rows(spark).repartition(5)).collect()), key=str)


def test_mix_emits_what_the_plan_says(spark):
    docs = rows(spark)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    taken = Counter()
    for r in mixing.plan(docs).collect():
        taken[r.doc_id] += r.taken
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len((r.text or "").split())
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in words.items() if v}


def test_many_sources_by_the_salted_join(spark, monkeypatch):
    plain = sorted(mixing.plan(rows(spark)).collect(), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(mixing.plan(rows(spark)).collect(), key=str) == plain


def test_targets_are_met_whatever_the_ids(spark):
    """Within four standard deviations of a sum of independent draws."""
    data = [(None if i % 3 else 5, ("same words here" if i % 2 else f"w{i} x y"), "aaaabbc"[i % 7], i, 0) for i in range(8000)]
    per = {}
    for r in mixing.plan(spark.createDataFrame(data, SCHEMA)).collect():
        key = (r.source_size, r.target)
        taken, squares = per.get(key, (0, 0))
        per[key] = (taken + r.taken, squares + r.size**2)
    assert len(per) == 3
    for (_, target), (taken, squares) in per.items():
        assert abs(taken - target) <= 4 * (squares / 4) ** 0.5


def test_clashing_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 7, 9)], "doc_id long, text string, source string, _draw int, _copies int")
    assert {tuple(r) for r in mixing.mix(docs).collect()} == {(1, "a b", "s", 7, 9)}


def test_empty(spark):
    assert mixing.plan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
