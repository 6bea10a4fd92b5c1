"""Phrase counting: reduced trie regex == earliest-end greedy scan."""

import random

from penmark.functions import lexicon
from penmark.functions.phrases import family_pattern, reduce_family, trie_regex, validate_negative


def earliest_end_count(text, phrases):
    """Direct scan: repeatedly take the occurrence that ends first, resume after it."""
    pos, n = 0, 0
    while True:
        best = None
        for p in phrases:
            i = text.find(p, pos)
            if i >= 0:
                end = i + len(p)
                if best is None or end < best:
                    best = end
        if best is None:
            return n
        n += 1
        pos = best


def test_reduction_drops_containing_phrases():
    kept = reduce_family(lexicon.BUZZWORD)
    assert "delivers both" not in kept and "next.js 13/14" not in kept
    assert len(kept) == 89
    assert len(reduce_family(lexicon.NOT_JUST)) == 18
    assert len(reduce_family(lexicon.DEVLOG)) == 31
    assert len(reduce_family(lexicon.BACKSTORY)) == 29
    assert len(reduce_family(lexicon.PERSPECTIVE)) == 12


def test_negative_phrases_contain_positive():
    validate_negative(lexicon.BUZZWORD, lexicon.NEGATIVE_BUZZWORD)


def test_trie_counts_equal_direct_scan(spark):
    from pyspark.sql import functions as F

    rng = random.Random(7)
    rows = []
    for fam, phrases in lexicon.FAMILIES.items():
        pieces = phrases + [" ", "a", "x", "day", ".", "’", "'", "-"]
        for i in range(150):
            text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
            rows.append((fam, i, text, earliest_end_count(text, phrases)))
    df = spark.createDataFrame(rows, "fam string, i int, text string, expected int")
    out = None
    for fam in lexicon.FAMILIES:
        part = df.where(F.col("fam") == fam).select(
            "fam", "text", "expected", F.regexp_count("text", F.lit(family_pattern(fam))).alias("got")
        )
        out = part if out is None else out.unionByName(part)
    bad = out.where(F.col("got") != F.col("expected")).collect()
    assert not bad, bad[:5]


def test_trie_regex_shape():
    rx = trie_regex(["modern", "meaningful", "the app"])
    assert rx.startswith("(?:")
    assert "\\." in trie_regex(["next.js 13"])
