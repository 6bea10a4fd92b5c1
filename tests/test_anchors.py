"""Anchored phrase counts and rare characters against plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from penmark.functions import lexicon
from penmark.functions.charclass import COMMON_RUN, DASH, GRAPHEME_EXTEND, QUOTE
from penmark.functions.emoji import GATE
from penmark.functions.metrics import ANCHORED, ARROWS, with_text_metrics
from penmark.functions.phrases import anchor_pattern, family_anchor_pattern, family_phrases, reduce_family
from penmark.operators import text_ops

METRIC = {"_n_devlog": "devlog_count", "_n_not_just": "not_just_count", "_n_backstory": "backstory_count"}


def _disjoint(text, phrases):
    """Non-overlapping occurrences, earliest end first."""
    n = at = 0
    while True:
        ends = [i + len(p) for p in phrases if (i := text.find(p, at)) >= 0]
        if not ends:
            return n
        n, at = n + 1, min(ends)


def _texts(family, k):
    rng = random.Random(k)
    phrases = family_phrases(family)
    parts = [*phrases, *[p[:-1] for p in phrases], *[p[1:] for p in phrases], " ", "x", "\u00e9", "\U0001F680", "a"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 4))).strip() or "x" for _ in range(400)]


@pytest.mark.parametrize("family", sorted(ANCHORED.values()))
def test_anchors_find_every_occurrence(spark, family):
    phrases = family_phrases(family)
    df = spark.createDataFrame([(t,) for t in _texts(family, 7)], "t string")
    for r in df.select("t", F.regexp_count("t", F.lit(family_anchor_pattern(family))).alias("n")).collect():
        whole = _disjoint(r.t, phrases)
        assert (r.n == 0) == (whole == 0), r
        assert r.n != 1 or whole == 1, r


@pytest.mark.parametrize("column,metric", METRIC.items())
def test_anchored_counts_are_the_plain_ones(spark, column, metric):
    family = ANCHORED[column]
    texts = [" ".join(t.split(" ")).replace("  ", " ") for t in _texts(family, 11)]
    texts = [t for t in texts if t == t.strip()]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in with_text_metrics(df, metrics=[metric]).collect():
        assert r[metric] == _disjoint(r.text.replace("  ", " "), family_phrases(family)), r


def test_own_phrases_are_anchored(spark):
    own = ["banana", "nab", "an"]
    df = spark.createDataFrame([(0, "bananab"), (1, "nab"), (2, "xx"), (3, None)], "id long, text string")
    got = {r.id: r.devlog_count for r in with_text_metrics(df, metrics=["devlog_count"], lexicons={"devlog": own}).collect()}
    assert got == {0: _disjoint("bananab", reduce_family(own)), 1: 1.0, 2: 0.0, 3: None}


def test_common_runs_hold_no_counted_character(spark):
    """Every character that the rare counts look for survives the common runs."""
    chars = [chr(c) for c in range(1, 0x1FB00) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    counted = F.lit(False)
    for pattern in (DASH, QUOTE, ARROWS, GATE, GRAPHEME_EXTEND):
        counted = counted | F.col("c").rlike(pattern)
    assert df.where(counted & F.col("c").rlike(COMMON_RUN)).count() == 0


def test_phrase_hits_of_all_families(spark):
    df = spark.createDataFrame([("Modern modern English (e.g. as a day",), ("nothing",), (None,)], "text string")
    got = {(r.family, r.phrase): r.n for r in text_ops.phrase_hits(df).collect()}
    assert got == {("buzzword", "modern"): 2, ("negative", "modern english"): 1, ("fancy", "(e.g."): 1,
                   ("devlog", "day"): 1, ("backstory", "as a"): 1}


def test_anchor_pattern_needs_phrases():
    with pytest.raises(ValueError):
        anchor_pattern([])
    assert all(anchor_pattern([p]) for p in lexicon.FANCY)
