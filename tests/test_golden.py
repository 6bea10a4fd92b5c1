"""Golden cases: text -> expected raw counts (FIXTURES.md §3 and §4)."""

import pytest

from metric_rows import metrics_of
from penmark.functions.lexicon import METRIC_ORDER

CASES = [
    ("", dict(sent=1)),
    ("Hello, world!", dict(sent=1)),
    ("a-b -- c -> d – e — f", dict(sent=1, irregular_dashes=2)),
    ("x -́ y", dict(sent=1, irregular_dashes=1)),
    ("Wait.... what...... ok…", dict(sent=3, irregular_ellipsis=4)),
    ("“Hi” it’s", dict(sent=1, irregular_quotations=3)),
    ("ok ↔ → ⇒ ↕", dict(sent=1, emoji=2, irregular_arrows=2)),
    ("👍👍🏽 🇺🇸 © done", dict(sent=1, emoji=4)),
    ("It’s not just a modern todo app — it’s more than a tool.",
     dict(sent=1, buzz=2, not_just_count=2, irregular_quotations=2, irregular_dashes=1)),
    ("I made the app in modern english", dict(sent=1)),
    ("Today, Monday: Devlog #3", dict(sent=1, devlog_count=3, hashtags=1)),
    ("we ran. Then we us them all", dict(sent=2, incorrect_perspective_count=2)),
    ("Note: x\n12: y\nhttps://x.y\n: z\nn1: q", dict(sent=6, labels=2)),
    ("#a ## # x#y", dict(sent=1, hashtags=2)),
    ("A\n\n\nB\n\n\n\nC", dict(sent=3)),
    ("　 HI À \n\n", dict(sent=1)),
    ("He was asked as a joke", dict(sent=1, backstory_count=2)),
    ("Tips (e.g. this) &amp; that &lt;", dict(sent=3, html_escape_count=1, mr_fancy_pants=1)),
    ("this isn’t a prototype", dict(sent=1, not_just_count=1, irregular_quotations=1)),
    ("next.js 13/14 delivers both", dict(sent=2, buzz=2)),
    ("🚀 modern ✨ developers!", dict(sent=1, emoji=2, buzz=3)),
    ("x ↔︎ y", dict(sent=1, irregular_arrows=1)),
    ("#️⃣ 5 1️⃣", dict(sent=1, emoji=2, hashtags=1)),  # a keycap word starts with #
    ("👨‍👩‍👧 family", dict(sent=1, emoji=1)),
]

MARKDOWN = [
    ("# A\n\n**b** and *c*", 3), ("> q1\n> q2", 1), ("- a\n- b", 0), ("`code`", 0),
    ("a\n\n---\n\nb", 1), ("[t](http://x.y) ![i](z.png)", 2), ("http://x.y", 0),
    ("~~x~~ $y$ - [ ] z", 0), ("• a • b", 2), ("eux*** ouier### on***", 0),
    ("\n\n## Features\n\n**Fast** and *small*, see [docs](http://x.y)\n\n> quoted\n\n• dot", 6),
    ("```py\n# x\n**y**\n```\n# z", 2), ("```\n```\n```\n```", 2), ("***x***", 2),
    ("_a_ and __b__", 2), ("snake_case_name", 0), ("2 * 3 * 4", 0), ("#tag and # not", 0),
    ("Title\n===\ntext", 1), ("Title\n---\ntext", 1), ("# A\n# B\n## C", 3),
    ("p\n\n    code1\n    code2\n\nq", 1), ("> a\n\n> b", 2), ("a <b>c</b> <http://x.y>", 3),
    ("<!-- c -->", 1), ("* * *", 1),
    ("\\*not emphasis\\* and \\[no](link)", 0), ("`a\\` *b*", 1),
]


def _counts(r):
    sent = r.sentence_count
    got = {"sent": sent}
    for m in METRIC_ORDER:
        v = r[m]
        if m == "emoji_rate":
            e = round(v * sent / 5)
            if e:
                got["emoji"] = e
        elif m == "buzzword_rate":
            b = round(v * sent / 2)
            if b:
                got["buzz"] = b
        elif m == "irregular_markdown":
            continue
        elif v:
            got[m] = int(v)
    return got


def test_golden_metrics(spark):
    rows = metrics_of(spark, [t for t, _ in CASES])
    bad = [(t, _counts(r), exp) for (t, exp), r in zip(CASES, rows) if _counts(r) != exp]
    assert not bad, bad


def test_markdown_cases(spark):
    rows = metrics_of(spark, [t for t, _ in MARKDOWN])
    bad = [(t, r.irregular_markdown, exp) for (t, exp), r in zip(MARKDOWN, rows) if r.irregular_markdown != exp]
    assert not bad, bad


def test_rates_are_per_sentence(spark):
    (r,) = metrics_of(spark, ["🚀. 🚀. modern. x."])
    assert r.sentence_count == 4
    assert r.emoji_rate == pytest.approx(5 * 2 / 4)
    assert r.buzzword_rate == pytest.approx(2 * 1 / 4)


def test_null_text_gives_null_metrics(spark):
    from penmark.functions.metrics import with_text_metrics

    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    r = with_text_metrics(df).collect()[0]
    assert all(r[m] is None for m in METRIC_ORDER)


def test_ascii_uppercase_does_not_change_metrics(spark):
    texts = ["It’s not just a modern todo app — it’s more than a tool.", "Devlog #3: Today, we built it"]
    a = metrics_of(spark, texts)
    b = metrics_of(spark, [t.upper() for t in texts])
    for x, y in zip(a, b):
        for m in METRIC_ORDER:
            if m != "irregular_markdown":
                assert x[m] == y[m], m


def test_ascii_only_lowercase_and_unicode_trim(spark):
    from pyspark.sql import functions as F

    from penmark.functions.normalize import ascii_lower, t1

    df = spark.createDataFrame([("　 HI ÀİA \n\n",)], "text string")
    r = df.select(t1(F.col("text")).alias("t1"), ascii_lower(F.col("text")).alias("lo")).collect()[0]
    assert r.t1 == "hi Àİa"
    assert "À" in r.lo and "İ" in r.lo


def test_custom_lexicons(spark):
    import pytest as _pytest

    from penmark.functions.metrics import with_text_metrics

    df = spark.createDataFrame([(0, "We shipped the widget. The widget rocks!")], "doc_id long, text string")
    lex = {"buzzword": ["widget"], "negative": ["widget rocks"], "backstory": ["shipped"]}
    r = with_text_metrics(df, lexicons=lex).collect()[0]
    assert r.buzzword_rate == 2 * (2 - 1) / 2 and r.backstory_count == 1.0
    # replacing the buzzwords alone leaves negatives that contain none of them
    with _pytest.raises(ValueError):
        with_text_metrics(df, lexicons={"buzzword": ["widget"]})
    with _pytest.raises(ValueError):
        with_text_metrics(df, lexicons={"nonsense": ["x"]})


def test_metrics_do_not_depend_on_partitioning(spark):
    from penmark.functions.metrics import with_text_metrics
    from penmark.plans.marked import marked_documents

    docs = marked_documents(spark, "/root/testdata/sf0.001")
    one = with_text_metrics(docs.coalesce(1))
    many = with_text_metrics(docs.repartition(8, "doc_id"))
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_joiner_run_breaks_like_uax29(spark):
    (r,) = metrics_of(spark, ["👍‍‍© and 👨‍👩‍👧"])
    assert round(r.emoji_rate * r.sentence_count / 5) == 2  # © and the family; 👍 + two joiners is no emoji
