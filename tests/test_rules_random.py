"""Native expressions == plain per-character scan, on random strings."""

import random

import pytest

import rules_scan as rs
from metric_rows import metrics_of
from penmark.functions import lexicon
from penmark.functions.emoji import emoji_table

ALPHABET = (
    list("aAbZ xyz#:.!?\n\t-—–“’…→↔⇒&;()0123")
    + ["　", " ", "́", "‍", "️", "é", "À", "ß"]
    + ["🚀", "✨", "👍", "🏽", "🇺", "🇸", "©", "1️⃣", "\r"]
    + ["modern ", "the app ", " we ", "day", "as a ", "(e.g. ", "&amp;", "...", "it’s not just ", "devlog #", "made the app"]
    # emoji sequences holding arrows, a tag flag, letter numbers and combining letters, odd separators
    + ["↔️", "🙂‍↔️", "🏃‍➡️", "🏴󠁧󠁢󠁳󠁣󠁴󠁿", "#⃣", "*️⃣", "‑", "−", "ⅷ", "ͅ", "Ǆ", "\x0b", "\x85", "a:", "12:", "\n\n\n"]
)


def _random_texts(n, seed=11):
    """Random strings (joiner runs included: the emoji pass restores the
    UAX #29 break that Java's grapheme matcher misses after them)."""
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("seed", [11, 12])
def test_native_equals_scan(spark, seed):
    texts = _random_texts(1500, seed)
    rows = metrics_of(spark, texts)
    table = emoji_table(spark)
    fams = {f: lexicon.FAMILIES[f] for f in ("not_just", "devlog", "backstory", "perspective", "fancy")}
    bad = []
    for text, r in zip(texts, rows):
        a = rs.t1(text)
        b = rs.t2(a)
        sent = rs.sentences(a)
        g = rs.grapheme_counts(b, table)
        buzz = rs.earliest_end(b, lexicon.BUZZWORD) - rs.earliest_end(b, lexicon.NEGATIVE_BUZZWORD)
        exp = {
            "sentence_count": sent,
            "labels": rs.labels(a),
            "hashtags": rs.hashtags(b),
            "emoji_rate": g["emoji"] * 5 / sent,
            "buzzword_rate": buzz * 2 / sent,
            "irregular_dashes": g["dash"],
            "irregular_arrows": g["arrow"],
            "irregular_quotations": g["quote"],
            "irregular_ellipsis": rs.earliest_end(b, lexicon.ELLIPSIS),
            "html_escape_count": b.count("&amp;"),
            "not_just_count": rs.earliest_end(b, fams["not_just"]),
            "devlog_count": rs.earliest_end(b, fams["devlog"]),
            "backstory_count": rs.earliest_end(b, fams["backstory"]),
            "incorrect_perspective_count": rs.earliest_end(b, fams["perspective"]),
            "mr_fancy_pants": rs.earliest_end(b, fams["fancy"]),
        }
        for k, v in exp.items():
            if abs(r[k] - v) > 1e-9:
                bad.append((repr(text), k, r[k], v))
    assert not bad, bad[:10]
