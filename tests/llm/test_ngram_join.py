import random
import re

import numpy as np
import pytest

from penmark.llm import ngram_join

SCHEMA = "doc_id long, text string, node int, size int, sig string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, num, den):
    sets, up = [grams(t, n) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and den * len(x & sets[j]) >= num * len(x | sets[j]):
                up[root(i)] = root(j)
    return [{"doc_id": d, "n_shingles": len(sets[i]), "component_id": min((rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None), default=None)} for i, (d, _) in enumerate(rows)]


def data():
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyzXYZ")
    common = [" ".join(word() for _ in range(60)) for _ in range(2)]
    texts = []
    for size in (1, 2, 3, 8, 30, 60, 150, 400, 1500):
        for _ in range(3):
            base = [word() for _ in range(size)]
            if size > 30:
                base += rng.choice(common).split()
            for k in range(9):
                t = list(base)
                for _ in range(rng.randrange(k + 1)):
                    t[rng.randrange(len(t))] = word()
                texts.append(rng.choice([" ", "\n", "  \t"]).join(t))
    texts += [common[0]] * 5 + [None, "", " \n", "A b c", "a B c", "a\x85b c d", "a\xa0b c d"]
    return [*enumerate(texts), (3, texts[3]), (None, texts[0]), (None, "lone words here only"), (5000, texts[9]), (5000, "another text under that id"), (None, texts[9]), (None, texts[9]), (5, texts[3])]


@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 4, 5), (2, 1, 2)])
def test_against_brute_force(spark, same, n, num, den, monkeypatch):
    rows = data()
    df = spark.createDataFrame([(*r, 1, 2, "s") for r in rows], SCHEMA).repartition(4)
    same(ngram_join.near_duplicates(df, n, num, den), brute(rows, n, num, den))
    if n == 3:
        monkeypatch.setattr(ngram_join, "BROADCAST_IDS", -1)
        monkeypatch.setattr(ngram_join, "FREQUENT", 2)
        same(ngram_join.near_duplicates(df, n, num, den), brute(rows, n, num, den))


def test_one_of_each_group_stays(spark):
    rows = data()
    df = spark.createDataFrame([(*r, 1, 2, "s") for r in rows], SCHEMA)
    # brute force names components by row here, as ids are null and repeated
    parts = [e["component_id"] for e in brute([(i, x) for i, (_, x) in enumerate(rows)], 5, 4, 5)]
    words = [bool(grams(x, 5)) for _, x in rows]
    want = []
    for part in set(parts):
        members = [rows[i] for i in range(len(rows)) if parts[i] == part]
        if not words[part]:
            want += [(d, x) for d, x in members]
            continue
        least = min(((d is None, d or 0) for d, _ in members))
        want.append((None if least[0] else least[1], None))
    out = ngram_join.drop_near_duplicates(df)
    assert out.columns == df.columns
    got = out.collect()
    key = lambda d: (d is None, d or 0)
    assert sorted((r.doc_id for r in got), key=key) == sorted((d for d, _ in want), key=key)
    # one row of each component with words, by its own text
    texts = {}
    for i, (_, x) in enumerate(rows):
        texts.setdefault(x, parts[i])
    kept = [texts[r.text] for r in got if grams(r.text, 5)]
    assert len(kept) == len(set(kept)) == len({p for p in parts if words[p]})
    assert ngram_join.drop_near_duplicates(df.limit(0)).count() == 0


def test_prefixes_hide_no_link():
    """Linked sets share an entry that lies in both prefixes, whatever is frequent."""
    rng = np.random.default_rng(1)
    for size in (1, 2, 5, 20, 31, 33, 64, 130, 700):
        for share in (0, 0.5, 1):
            x = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
            levels = np.zeros(1 << ngram_join.LEVEL_BITS, np.uint8)
            often = x[rng.random(len(x)) < share]
            levels[(often >> np.uint64(64 - ngram_join.LEVEL_BITS)).astype(np.int64)] = rng.integers(3, 9, len(often))
            spare = len(x) - -(-9 * len(x) // 10)
            for lost in range(spare + 1):
                y = np.sort(rng.permutation(x)[lost:])
                if 10 * len(y) < 9 * len(x):
                    continue
                a, b = (dict(zip(*(c.tolist() for c in ngram_join.signatures(s, levels, 9, 10)))) for s in (x, y))
                least = -(-9 * (len(x) + len(y)) // 19)
                assert any(a[s] <= len(x) - least and b[s] <= len(y) - least for s in a.keys() & b.keys())


@pytest.mark.parametrize("num,den", [(9, 10), (4, 5)])
def test_sketches_rule_out_no_link(num, den):
    rng = np.random.default_rng(2)
    allow = lambda x, y: ngram_join.sketches_allow(ngram_join.sketch(x), ngram_join.sketch(y), len(x) + len(y), num, den)
    ruled_out = 0
    for size in (1, 2, 9, 63, 64, 127, 128, 500, 5000):
        whole = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        for lost in range(0, len(whole) // 2 + 1, max(1, size // 40)):
            for new in (0, lost // 2, lost):
                y = np.unique(np.r_[rng.permutation(whole)[lost:], rng.integers(0, 1 << 63, new).astype(np.uint64)])
                shared = len(np.intersect1d(whole, y))
                if den * shared >= num * (len(whole) + len(y) - shared):
                    assert allow(whole, y) and allow(y, whole)
                else:
                    ruled_out += not allow(whole, y)
    assert ruled_out
    far = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    assert not allow(whole[:300], far)
