"""Large lexicons by dictionary join, against the regexes and a plain scan."""

import random

import pytest
from pyspark.sql import functions as F

from penmark.functions import lexicon as lex
from penmark.operators import lexicon_join as lj
from penmark.operators import text_ops

ROWS = "doc_id long, text string"


def _builtin(spark):
    return spark.createDataFrame([(f, p) for f, ps in lex.FAMILIES.items() for p in ps], "family string, phrase string")


def _flat(text):
    """T2 of an ASCII text without odd white space."""
    return text.lower().strip().replace("\n\n", "\n").replace("\n", " ").replace("  ", " ")


def _scan(text, phrases):
    """Counted occurrences: the first to end, then from its end on."""
    by_last = {}
    for p in phrases:
        by_last.setdefault(p[-1], set()).add(p)
    out, to = [], 0
    for end in range(1, len(text) + 1):
        ends = [p for p in by_last.get(text[end - 1], ()) if end - len(p) >= to and text.endswith(p, to, end)]
        if ends:
            p = min(ends, key=len)
            out.append((end - len(p), end, p))
            to = end
    return out


def _got(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["doc_id"], r["family"]), []).append((r["start"], r["end"], r["phrase"]))
    return {k: sorted(v) for k, v in out.items()}


def test_random_texts_and_phrases(spark, monkeypatch):
    monkeypatch.setattr(lj, "BLOCK", 16)  # many block borders
    rng = random.Random(4)
    word = lambda a, b: "".join(rng.choice("ab c") for _ in range(rng.randint(a, b)))
    texts = [(i, word(0, 90)) for i in range(120)]
    families = {f: sorted({w for _ in range(25) if (w := word(1, 9))}) for f in ("x", "y", "z")}
    lexicon = spark.createDataFrame([(f, p) for f, ps in families.items() for p in ps * 2], "family string, phrase string")
    got = _got(lj.lexicon_hits(spark.createDataFrame(texts, ROWS), ["doc_id"], lexicon))
    want = {(i, f): hits for i, t in texts for f, ps in families.items() if (hits := _scan(_flat(t), ps))}
    assert got == want and len(want) > 100


def test_broadcast_or_not_makes_no_difference(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Today, we leverage it… Devlog #1"), (2, "robust and seamless")], ROWS)
    one = _got(lj.lexicon_hits(docs, ["doc_id"], _builtin(spark)))
    monkeypatch.setattr(lj, "BROADCAST_ROWS", 0)
    assert _got(lj.lexicon_hits(docs, ["doc_id"], _builtin(spark))) == one and one


def test_builtin_families_equal_the_regexes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = [(-i, f"{a} {b}, {a}{b}! {'…' * (i % 4)}") for i, (a, b) in enumerate(zip(lex.BUZZWORD, reversed(lex.FANCY + lex.DEVLOG)), 1)]
    docs = docs.unionByName(spark.createDataFrame(extra + extra[:2], ROWS))
    want = {(r["family"], r["phrase"]): r["n"] for r in text_ops.phrase_hits(docs).collect()}
    got = {(r["family"], r["phrase"]): r["n"] for r in lj.lexicon_totals(docs, _builtin(spark)).collect()}
    assert got == want and len(want) > 20


def test_hundred_thousand_phrases(spark):
    rng = random.Random(8)
    syllables = ["ka", "lo", "mi", "ten", "ru", "sha", "po", "e", "vi", "dor"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    phrases = sorted({f"{word()} {word()}" for _ in range(130_000)})[:100_000]
    assert len(phrases) == 100_000
    texts = [(i, " ".join(word() for _ in range(rng.randint(5, 400)))) for i in range(60)]
    texts.append((99, " ".join(rng.choice(phrases) for _ in range(6000))))  # a long one
    lexicon = spark.createDataFrame([("big", p) for p in phrases], "family string, phrase string").repartition(4)
    got = _got(lj.lexicon_hits(spark.createDataFrame(texts, ROWS), ["doc_id"], lexicon))
    found = set(phrases)
    lengths = sorted({len(p) for p in phrases})
    want = {}
    for i, t in texts:
        hits, to = [], 0
        for end in range(1, len(t) + 1):
            p = next((t[end - n : end] for n in lengths if end - n >= to and t[end - n : end] in found), None)
            if p:
                hits.append((end - len(p), end, p))
                to = end
        if hits:
            want[(i, "big")] = hits
    assert got == want and len(want[(99, "big")]) >= 5000


def test_defined_cases(spark):
    docs = spark.createDataFrame(
        [(1, "abc abc", "k"), (1, "abc", "k"), (1, "abc", "k"), (None, "xabc", "k"), (None, None, "k"), (2, "", "k"), (3, "😀abc😀", "k")],
        "doc_id long, text string, phrase string",
    )
    lexicon = spark.createDataFrame(
        [("f", "abc", 1), ("f", "abc", 2), ("f", None, 3), ("f", "", 4), (None, "😀", 5), ("g", "zzz", 6)], "family string, phrase string, n long"
    )
    got = sorted((str(r["doc_id"]), sorted(r["counts"].items())) for r in lj.lexicon_counts(docs, ["doc_id"], lexicon).collect())
    want = [("1", 2), ("1", 1), ("1", 1), ("None", 1), ("None", 0), ("2", 0)]
    assert got == sorted([(d, [("f", n)] if n else []) for d, n in want] + [("3", [("f", 1), ("null", 2)])])
    totals = {(r["family"], r["phrase"]): r["n"] for r in lj.lexicon_totals(docs, lexicon).collect()}
    assert totals == {("f", "abc"): 6, (None, "😀"): 2}
    assert lj.lexicon_counts(docs, ["doc_id"], lexicon.where("false")).where(F.size("counts") > 0).count() == 0
    assert lj.lexicon_totals(docs.where("false"), lexicon).count() == 0
    with pytest.raises(ValueError):
        lj.lexicon_totals(docs, spark.createDataFrame([("f", "x" * 5000)], "family string, phrase string"))


def _codes(spark, lexicon, windows):
    """Windows given as bytes, each a block by itself: [(place, size)] of each."""
    posts = lj.postings(lexicon).localCheckpoint()
    sizes = sorted(r[0] for r in posts.select(F.length("gram")).distinct().collect())
    df = spark.createDataFrame([(i, w.hex()) for i, w in enumerate(windows)], "i int, hex string").repartition(1)
    df = df.select("i", F.unhex("hex").cast("string").alias("w"))
    code = lj._places(lj._held(posts), sizes)("w", F.lit(0), F.length("w"), F.length("w"))
    return {r["i"]: [(c >> 3, c & 7) for c in r["c"]] for r in df.select("i", code.alias("c")).collect()}, sizes


def test_few_places_are_looked_up(spark):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(400))
    texts = [f"{text[:200]} {p} {text[i:300 + i]}" for i, ps in enumerate(lex.FAMILIES.values()) for p in ps]
    lexicon = _builtin(spark)
    got, _ = _codes(spark, lexicon, [t.encode() for t in texts])
    assert sum(map(len, got.values())) < sum(map(len, texts)) / 20
    anchors = {(r["gram"]) for r in lj.postings(lexicon).collect()}
    for i, t in enumerate(texts):
        want = {(at, n) for n in range(1, lj.GRAM + 1) for at in range(len(t) - n + 1) if t[at : at + n] in anchors}
        assert want <= set(got[i]) and want


def test_places_of_texts_that_are_not_utf8(spark):
    lexicon = spark.createDataFrame([("f", "abc"), ("f", "€"), ("f", "seamless")], "family string, phrase string")
    # the second and third are UTF-8 only when joined
    got, sizes = _codes(spark, lexicon, [b"xabc", b"abc\xe2", b"\x82\xacabc", "😀€".encode(), b"", b"zz", b"\xffabc"])
    assert sizes == [1, 3, 5]
    whole = lambda n: [(at, s) for at in range(n) for s in sizes]
    assert got == {0: [(1, 3)], 1: whole(4), 2: whole(5), 3: [(1, 1)], 4: [], 5: [], 6: whole(4)}
