import hashlib
import random
import re

from penmark.llm import winnowing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, key int, item string, spans int"


def brute(docs, items):
    split = lambda t: WORD.findall((t or "").translate(LOWER))
    grams = {}
    for name, text in items:
        w = split(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            grams.setdefault(tuple(w[i : i + 13]), set()).add(str(name))
    out = []
    for doc, text in docs:
        w, hit, names = split(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (found := grams.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    names |= found
        out.append({
            "doc_id": doc, "n_words": len(w), "n_hit": len(hit), "n_items": len(names),
            "items_sha256": hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), "contaminated": bool(hit) and 20 * len(hit) >= len(w),
        })
    return out


def data():
    rng = random.Random(5)
    word = lambda: rng.choice(["aa", "Bé", "c1", "d", "e", "f", "g", "h", "\x85x", "ı"]) + str(rng.randrange(40))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([13, 14, 40, 12, 5, 1, 13, 100])]
    items += [(50, None), (51, "!!"), (52, items[2][1]), (53, "z " * 30), (10, "K-gram " * 13)]
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 12, 13, 50, 511, 524, 525, 1500, 6000])))) for i in range(60)]
    for i in range(0, 60, 2):
        text = items[rng.randrange(len(items))][1] or ""
        part = text.split()
        a = rng.randrange(max(1, len(part)))
        at = rng.randrange(len(docs[i][1]) + 1)
        docs[i] = (i, docs[i][1][:at] + " " + "  ".join(part[a : a + rng.choice([12, 13, 20])]).upper() + ", " + docs[i][1][at:])
    docs += [(100, None), (101, ""), (102, items[2][1]), (102, items[2][1]), (103, "z " * 3000), (None, items[0][1])]
    return docs, items


def test_against_brute_force(spark, same, monkeypatch):
    docs, items = data()
    d = spark.createDataFrame([(*r, 1, "x", 2) for r in docs], SCHEMA)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, n_item int")
    same(winnowing.contamination(d, b).drop("key"), brute(docs, items))
    clean = sorted((r["doc_id"] is None, r["doc_id"]) for r in brute(docs, items) if not r["contaminated"])
    out = winnowing.decontaminate(d, b)
    assert out.columns == d.columns and sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == clean
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", -1)
    same(winnowing.contamination(d, b).drop("key"), brute(docs, items))


def test_empty(spark, same):
    docs, items = data()
    d = spark.createDataFrame([(*r, 1, "x", 2) for r in docs], SCHEMA)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert winnowing.contamination(d.limit(0), b).count() == 0
    same(winnowing.contamination(d, b.limit(0)).drop("key"), brute(docs, []))
