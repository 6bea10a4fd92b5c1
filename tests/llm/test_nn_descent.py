import numpy as np

from penmark.llm import nn_descent

SCHEMA = "vec_id long, embedding array<float>, label int, node int, vec string"


def data():
    rng = np.random.default_rng(8)
    rows = []

    def add(x, label):
        rows.append((len(rows), [float(v) for v in np.asarray(x, np.float32)], label))

    for label in (0, 1, 2):
        for size, noise in ((60, 0.02), (40, 0.045), (2, 0.03), (2, 0.03), (3, 0.04), (7, 0.05), (1, 0)):
            base = rng.standard_normal(16)
            base /= np.linalg.norm(base)
            for _ in range(size):
                add((base + rng.standard_normal(16) * noise) * rng.choice([1, 3]), label)
        for _ in range(30):
            add(rng.standard_normal(16), label)
    for _ in range(5):
        add(rows[3][1], 0)
    rows.append((900, rows[0][1], None))
    rows.append((901, None, 0))
    rows.append((902, [0.0] * 16, 0))
    rows.append((903, [float("nan")] + [1.0] * 15, 0))
    rows.append((904, [None] + [1.0] * 15, 0))
    rows.append((905, [float("inf")] * 16, 0))
    rows.append((906, [], 0))
    rows.append((907, rows[0][1][:8], 0))
    rows.append((908, rows[0][1][:8], 0))
    rows.append((907, rows[0][1][:8], 1))
    return rows


def brute(rows):
    good = lambda r: r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
    unit = [np.array(r[1], float) / np.linalg.norm(r[1]) if good(r) else None for r in rows]
    n, up = len(rows), list(range(len(rows)))
    links = np.zeros(n, int)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    comp = [min(rows[j][0] for j in range(n) if root(j) == root(i)) for i in range(n)]
    return [{"vec_id": r[0], "n_links": int(links[i]), "component_id": comp[i], "kept": r[0] == comp[i]} for i, r in enumerate(rows)]


def test_against_brute_force(spark, same, monkeypatch):
    rows = data()
    df = spark.createDataFrame([(*r, 1, "v") for r in rows], SCHEMA).repartition(3)
    expected = brute(rows)
    assert max(e["n_links"] for e in expected) > 40
    same(nn_descent.near_duplicates(df), expected)
    monkeypatch.setattr(nn_descent, "BLOCK", 16)
    same(nn_descent.near_duplicates(df), expected)


def test_recall_before_the_audit(spark):
    df = spark.createDataFrame([(*r, 1, "v") for r in data()], SCHEMA)
    _, nodes = nn_descent._nodes(df)
    comps = {r.node: r.comp for r in nn_descent.components(nn_descent._descend(nodes, 0, nn_descent.THRESHOLD)).collect()}
    true = nn_descent.audit(nodes).collect()
    assert np.mean([r.a in comps and comps[r.a] == comps.get(r.b) for r in true]) > 0.99


def test_empty(spark):
    assert nn_descent.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rare_pairs_with_few_orders(spark, same, monkeypatch):
    rng = np.random.default_rng(21)
    base = rng.standard_normal((2000, 64))
    for i in range(0, 80, 2):  # pairs of cosine of about 0.94, and nothing else near
        base[i + 1] = base[i] + rng.standard_normal(64) * np.linalg.norm(base[i]) / 8 * 0.36
    rows = [(i, [float(v) for v in np.asarray(x, np.float32)], 0, 1, "v") for i, x in enumerate(base)]
    expected = brute([r[:3] for r in rows])
    assert 40 < sum(e["n_links"] for e in expected) <= 80
    monkeypatch.setattr(nn_descent, "ORDERS", 1)
    monkeypatch.setattr(nn_descent, "AUDIT", 50)
    same(nn_descent.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)), expected)


def test_all_are_compared_after_the_last_try(spark, same, monkeypatch):
    rows = data()
    df = spark.createDataFrame([(*r, 1, "v") for r in rows], SCHEMA)
    monkeypatch.setattr(nn_descent, "_descend", lambda nodes, seed, threshold: nodes.selectExpr("node a", "node b").limit(0))
    monkeypatch.setattr(nn_descent, "AUDIT", 20)
    monkeypatch.setattr(nn_descent, "LARGEST", 100, raising=False)
    monkeypatch.setattr(nn_descent, "LINKED", 5, raising=False)
    same(nn_descent.near_duplicates(df), brute(rows))
