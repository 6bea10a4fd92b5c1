import random
import re
from collections import Counter, defaultdict

import duckdb

from penmark.llm import collocations
from penmark.llm.common import table

DOCS = "doc_id long, text string, lang string, row long, n int, fp string"


def brute(docs, least, top):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        known = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in known.items():
            if any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in known.items()):
                continue
            cuts = [(1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append({"lang": lang, "rank": rank, "phrase": phrase.decode(), "a": -a, "l": left, "r": right, "n": total[lang], "score": -score})
    return out


def corpus(seed, n):
    rnd = random.Random(seed)
    words = ["the", "of", "The", "éÉ", "x", "new york", "in a", "a\tb", "中", "stop.", "end,", "line\n", "q\x0bq", "  ", "A b c D e f", "né"]
    return [(i % 50 if i % 9 else None, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25))), rnd.choice(["en", "de", None, "und"])) for i in range(n)]


def frame(spark, docs):
    return spark.createDataFrame([(a, b, c, 1, 2, "f") for a, b, c in docs], DOCS)


def test_against_brute_force(spark, same):
    docs = corpus(1, 300) + [(1, None, "en"), (2, "", None), (3, "same words here again", "en")] + [(9, "same words here again", "en")] * 30
    same(collocations.collocations(frame(spark, docs), least=10, top=40), brute(docs, 10, 40))


def test_collisions_fall_apart(spark, same):
    docs = corpus(2, 200)
    for narrow in (64 - 3, 64 - 6):  # a handful of fingerprints for all phrases
        same(collocations.collocations(frame(spark, docs).repartition(3), least=8, narrow=narrow), brute(docs, 8, 2000))


def test_chunks_do_not_matter(spark, same, monkeypatch):
    docs = corpus(3, 200)
    monkeypatch.setattr(collocations, "CHUNK", 500)
    same(collocations.collocations(frame(spark, docs).coalesce(2), least=8), brute(docs, 8, 2000))


def test_one_long_text(spark, same):
    docs = [(1, "alpha beta gamma " * 3000, "en")]
    same(collocations.collocations(frame(spark, docs)), brute(docs, 100, 2000))


def test_nothing_frequent(spark):
    for docs in ([], [(1, None, None)], [(1, "a b c", "en")]):
        got = collocations.collocations(frame(spark, docs))
        assert got.collect() == [] and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_beyond_64_bits(spark):
    a, n = 4_000_000_000_000, 90_000_000_000_000_000
    got = spark.range(1).selectExpr(f"{a} a", f"{n} n", f"{a} l", f"{a + 1} r").select(collocations.score_column()).first()[0]
    assert got == 1000 * a * n // (a * (a + 1))


def test_twin(spark, same):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    rows = con.execute(collocations.ORACLE_SQL)
    names = [d[0] for d in rows.description]
    same(collocations.collocations(docs), [dict(zip(names, r)) for r in rows.fetchall()])
