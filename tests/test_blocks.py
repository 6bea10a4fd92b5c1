"""Markup events with block state: worked cases and a plain scan."""

import random

import duckdb
import pytest
from blocks_scan import scan
from test_golden import MARKDOWN

from penmark.functions.blocks import COUNTS, block_counts
from penmark.plans.blocks_sql import events_sql
from pyspark.sql import functions as F

CASES = [
    ("", 0),
    ("<div>\na\nb\n\nc <b>x</b>", 5),  # three lines of the block, two tags
    ("<pre>\n\n# x\n</pre>\n# y", 5),  # a raw block lasts over blank lines
    ("<!-- a\n\nb -->\n# h", 4),
    ("a\n<b>\nc", 1),  # a lone tag does not interrupt a paragraph
    ("<b>\nc\n\nd", 2),
    ("> a\n> > b\n> c", 2),  # nested quotes: one each
    ("> a\nlazy *b*\n\n> c", 3),
    ("- a\n\n    text", 0),  # under a list item: a paragraph
    ("- a\n\n      code\n\n  text", 1),
    ("- a\n- b\n\nc\n\n    code", 1),
    ("1. a\n   ```\n   # x\n   ```\n2. b", 1),
    ("- ```\n  x\ny\n# z", 2),  # a fence ends with its item
    ("a\n    b", 0),
    ("- - -\n* * *", 2),
    ("a\n2. # b\n1. # c", 1),
    ("> ```\n> # x\n# y", 3),  # a fence ends with its quote
    ("\tcode\r\n\r\n\tmore\rtext", 1),
]


def _counts(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.c for r in rows.select("i", block_counts(F.col("t")).alias("c")).orderBy("i").collect()]


@pytest.mark.parametrize("cases", [CASES, MARKDOWN], ids=["blocks", "as the patterns"])
def test_worked_cases(spark, cases):
    got = _counts(spark, [t for t, _ in cases])
    assert [(t, c.total) for (t, _), c in zip(cases, got)] == cases


def test_null_text(spark):
    assert _counts(spark, [None, "# a"])[0] is None


def _random_texts(n):
    rng = random.Random(5)
    heads = ["", "", "", "> ", "> > ", ">", "- ", "1. ", "2) ", "  ", "    ", "   ", "      ", "* - ", "\t"]
    bodies = ["", "", "a", "a b", "# h", "#", "#x", "---", "===", "- - -", "```", "````", "~~~", "```x", "<div>", "</div>", "a <div> b",
              "<b>", "<b> x", "</p>", "<!-- c", "c -->", "<!-- c -->", "<pre>", "</pre>", "<scripty>", "***", "____", "-", "1."]
    return ["\n".join(rng.choice(heads) + rng.choice(bodies) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_equal_to_a_plain_scan(spark):
    texts = _random_texts(4000)
    both = [(t, scan(t), {k: c[k] for k in COUNTS}) for t, c in zip(texts, _counts(spark, texts))]
    wrong = [x for x in both if x[1] != x[2]]
    assert set(COUNTS) == set(scan(""))
    assert not wrong, (len(wrong), wrong[0])


def test_twin_equal_to_a_plain_scan():
    texts = _random_texts(2000)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, x VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    rows = con.execute(f"SELECT i, {', '.join(COUNTS)} FROM ({events_sql('t', 'i', 'x')}) ORDER BY i").fetchall()
    wrong = [(t, scan(t), r) for t, r in zip(texts, rows, strict=True) if tuple(scan(t)[c] for c in COUNTS) != r[1:]]
    assert not wrong, (len(wrong), wrong[0])


def test_long_text_is_walked_in_one_pass(spark):
    [c] = _counts(spark, ["\n".join(["> q", "", "- a", "<p>", "", "    x"] * 20_000)])
    assert (c.quotes, c.html_lines) == (20_000, 20_000)
    deep, tag = _counts(spark, [">" * 20_000, "<a" + " b=c" * 20_000 + ">"])
    assert (deep.quotes, tag.html_lines) == (20_000, 1)
