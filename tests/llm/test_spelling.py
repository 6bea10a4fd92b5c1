import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from penmark.llm import spelling
from penmark.llm.common import table

DOCS = "doc_id long, text string, word string, n long, back int"


def counts(docs):
    found = Counter()
    for name, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if name is None else name}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: best[w] if w in best and n[best[w]] >= 5 * n[w] else None for w in n}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append({"word": w, "form": form[w], "root": root, "n": n[w], "n_near": len(near[w]), "form_n": n[form[w]] if form[w] else None})
    return out


def vocabulary(seed, n, letters):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(6, 9))) for _ in range(n)}
    return {w: rnd.choice([5, 6, 30, 200, 1000, 5000]) for w in words}


def test_against_brute_force(spark, same):
    for seed, n, letters in ((1, 700, "abc"), (2, 500, "abéÀÿ÷")):
        known = vocabulary(seed, n, letters)
        df = spark.createDataFrame(list(known.items()), "word string, n long")
        same(spelling.variants(df), brute(known))


def test_shards_hide_nothing(spark):
    known = vocabulary(3, 900, "abcd")
    df = spark.createDataFrame(list(known.items()), "word string, n long")
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(df, symbols=300).collect()}
    want = {w["word"]: w["n_near"] for w in brute(known) if w["n_near"]}
    assert {w: n for w, (n, _, _) in got.items()} == want


def test_words_and_dropped_letters(spark):
    rnd = random.Random(4)
    words = ["colour", "color", "Straße", "naïveté", "élèves", "xx", "longest-word", "don't", "ABCDEFG", "×÷×÷×÷", "Ωmegaword"] + ["w" + "".join(rnd.choice("xyz") for _ in range(7)) for _ in range(40)]
    docs = [(i if i % 7 else None, " ".join(rnd.choice(words) for _ in range(30))) for i in range(200)] + [(1, None), (2, ""), (3, "q" * 5000)] * 6
    name = next(i for i in range(1000, 10**6) if zlib.crc32(f"{i}:wording".encode()) % 199 == 0)
    docs += [(name, "Wording")] * 6
    rows = spark.createDataFrame([(a, b, "x", 1, 2) for a, b in docs], DOCS)
    want = counts(docs)
    assert {r.word: r.n for r in spelling.vocabulary(rows).collect()} == want and "q" * 5000 in want
    assert any(len(w) == 6 and one_edit(w, "wording") for w in want) and "wording" not in want


def test_long_words_of_one_length(spark, same):
    known = {"a" * 300: 1000, "a" * 299: 10, "a" * 150 + "b" + "a" * 149: 100, "b" + "a" * 299: 7}
    same(spelling.variants(spark.createDataFrame(list(known.items()), "word string, n long")), brute(known))


def test_check_sums():
    data = np.frombuffer("0:wordsé".encode() * 3 + b"x" * 500, np.uint8)
    starts, size = np.array([2, 0, 20, 27]), np.array([5, 8, 1, 400])
    seeds = np.array([zlib.crc32(b"12:"), 0, zlib.crc32(b"x"), zlib.crc32(b"7:")], np.uint32)
    want = [zlib.crc32(data[a : a + n].tobytes(), int(s)) for a, n, s in zip(starts, size, seeds)]
    assert spelling._crcs(data, starts, size, seeds).tolist() == want


def test_empty_and_no_words(spark):
    empty = spark.createDataFrame([], DOCS)
    assert spelling.variants(spelling.vocabulary(empty)).collect() == []
    few = spark.createDataFrame([(1, "short", "x", 1, 2), (2, None, "x", 1, 2)], DOCS)
    assert spelling.variants(spelling.vocabulary(few)).collect() == []


def test_twin(spark, same):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    rows = con.execute(spelling.ORACLE_SQL)
    names = [d[0] for d in rows.description]
    same(spelling.variants(spelling.vocabulary(docs)), [dict(zip(names, r)) for r in rows.fetchall()])
