"""The fifteen style metrics as one native projection.

``with_text_metrics(df)`` adds fifteen ``double`` columns (and the helper
``sentence_count``) computed by built-in string and regex functions only:
no Python runs per row, everything stays inside whole-stage codegen, and
the scan reads only the text column (plus whatever the caller keeps).
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import emoji as emoji_mod
from . import lexicon
from . import markdown as md
from . import spec as S
from .charclass import COMMON_RUN, DASH, GRAPHEME_EXTEND, HYPHEN_IN_GRAPHEME, QUOTE, WS, WS_CHARS, WSN
from .normalize import SENTENCE_SEGMENT
from .phrases import (
    anchor_pattern, family_anchor_pattern, family_pattern, family_pattern_fast, reduce_family, trie_regex, validate_negative,
)

METRICS = lexicon.METRIC_ORDER

# Arrows count only outside emoji graphemes. Emoji sequences never hold the
# plain arrows, but two arrows are emoji themselves (left-right, up-down)
# and also occur inside emoji ZWJ sequences: those are subtracted.
ARROWS = "[→↑↓↔↕⇒⇐⇑⇓➔➜]"
ARROW_PLAIN = "[→↑↓⇒⇐⇑⇓➔➜]"
EMOJI_ARROWS = "[↔↕]"
DASHES = DASH + "|" + HYPHEN_IN_GRAPHEME
HASHTAG = f"(?:^|[{WS}])#[^{WS}]"
LABEL_JAVA = f"(?:^|\\n)[{WSN}]*\\p{{IsAlphabetic}}[\\p{{IsAlphabetic}}{WSN}]*:"
LABEL_RE2 = f"(?:^|\\n)[{WSN}]*[\\p{{L}}\\p{{Nl}}][\\p{{L}}\\p{{Nl}}{WSN}]*:"


def _emoji_steps() -> S.Steps:
    """``_emoji_g``: emoji graphemes of T2 (Spark, exact); the SQL twin has no
    graphemes and takes single emoji code points instead."""
    from pyspark.sql import functions as F

    def g_spark(c, rare):
        return emoji_mod.emoji_graphemes(c, rare=rare)

    def g_sql(c, rare):
        return f"regexp_extract_all({c}, {S.sql_str(emoji_mod.single_codepoint_class())})"

    def n_spark(g):
        return F.when(g.isNull(), F.lit(None)).otherwise(F.size(g))

    def n_sql(g):
        return f"len({g})"

    def arrow_spark(t2, g, rare):
        inside = F.regexp_count(F.array_join(g, ""), F.lit(EMOJI_ARROWS))
        return F.regexp_count(rare, F.lit(ARROWS)) - inside

    def arrow_sql(t2, g, rare):
        return f"len(regexp_extract_all({t2}, {S.sql_str(ARROW_PLAIN)}))"

    x = S.col
    return [
        [("_emoji_g", S.native(g_spark, g_sql, x("_t2"), x("_rare")))],
        [
            ("_n_emoji", S.native(n_spark, n_sql, x("_emoji_g"))),
            ("_n_arrow", S.native(arrow_spark, arrow_sql, x("_t2"), x("_emoji_g"), x("_rare"))),
        ],
    ]


def normalize_steps(text: str = "text") -> S.Steps:
    x = S.col
    # of a text of ASCII alone, lower() changes A-Z only, and far faster
    other = S.spark_only(lambda c: F.octet_length(c) != F.length(c), x(text))
    lowered = S.quick(other, S.translate(x(text), string.ascii_uppercase, string.ascii_lowercase), S.spark_only(F.lower, x(text)))
    return [
        [("_t1", S.replace(S.trim(lowered, WS_CHARS), "\n\n", "\n"))],
        [("_t2", S.replace(S.replace(x("_t1"), "\n", " "), "  ", " "))],
    ]


# Families counted at every place where one of their phrases is anchored first
ANCHORED = {"_n_devlog": "devlog", "_n_buzz": "buzzword", "_n_not_just": "not_just", "_n_backstory": "backstory"}


def _anchored(pattern: str) -> S.E:
    return S.spark_only(lambda t2: F.regexp_count(t2, F.lit(pattern)), S.col("_t2"))


def _by_anchors(column: str, whole: S.E) -> S.E:
    """The count itself only where two or more phrases are anchored."""
    found = S.col(f"{column}_at")
    return S.quick(S.spark_only(lambda n: n > 1, found), whole, found)


def scan_steps(lexicons: dict[str, list[str]] | None = None) -> S.Steps:
    """Helpers of the Spark side: ``_rare``, the characters of T2 outside the
    common runs (in most texts few or none), to which the counts of single
    rare characters are confined, and the anchors of the larger families."""
    own = {c: reduce_family((lexicons or {}).get(f, [])) for c, f in ANCHORED.items()}
    at = [(f"{c}_at", _anchored(anchor_pattern(own[c]) if own[c] else family_anchor_pattern(f))) for c, f in ANCHORED.items()]
    return [[("_rare", S.spark_only(lambda t2: F.regexp_replace(t2, F.lit(COMMON_RUN), F.lit("")), S.col("_t2"))), *at]]


def _in_rare(pattern: str) -> S.E:
    """A count of single rare characters in T2."""
    return S.native(lambda t2, rare: F.regexp_count(rare, F.lit(pattern)), lambda t2, rare: S.to_sql(S.count(S.col(t2), pattern)),
                    S.col("_t2"), S.col("_rare"))


def gated(cond: S.E, col: S.E, pattern: str) -> S.E:
    """Count ``pattern`` only where a cheap necessary condition holds."""
    return S.when(cond, S.count(col, pattern), S.zero_or_null(col))


def _custom_patterns(lexicons: dict[str, list[str]] | None) -> dict[str, str]:
    """Trie patterns for user-supplied phrase families (same counting rule)."""
    if not lexicons:
        return {}
    unknown = set(lexicons) - set(lexicon.FAMILIES)
    if unknown:
        raise ValueError(f"unknown phrase families: {sorted(unknown)}")
    if "buzzword" in lexicons or "negative" in lexicons:
        validate_negative(lexicons.get("buzzword", lexicon.BUZZWORD), lexicons.get("negative", lexicon.NEGATIVE_BUZZWORD))
    return {f: trie_regex(reduce_family(p)) for f, p in lexicons.items()}


def count_steps(lexicons: dict[str, list[str]] | None = None) -> S.Steps:
    """Raw integer counts (prefixed ``_n_``) on T1/T2. ``lexicons`` replaces
    any of the phrase families (the fixed lists are the defaults)."""
    x = S.col
    t1, t2 = x("_t1"), x("_t2")
    custom = _custom_patterns(lexicons)
    steps = _default_count_steps(t1, t2)
    fam_col = {"ellipsis": "_n_ellipsis", "devlog": "_n_devlog", "buzzword": "_n_buzz", "negative": "_n_negative",
               "not_just": "_n_not_just", "backstory": "_n_backstory", "perspective": "_n_perspective",
               "fancy": "_n_fancy"}
    by_col = {fam_col[f]: pat for f, pat in custom.items()}


    def own(name: str) -> S.E:
        whole = S.count(t2, by_col[name])
        return _by_anchors(name, whole) if name in ANCHORED else whole

    return [[(n, own(n) if n in by_col else e) for n, e in steps[0]]]


def _default_count_steps(t1: S.E, t2: S.E) -> S.Steps:
    return [
        [
            ("_n_sent", S.greatest(S.lit(1), S.count(t1, SENTENCE_SEGMENT))),
            # cheap gates: no ':' means no label, no '#' means no hashtag
            ("_n_labels", S.when(S.contains(t1, ":"), S.count(t1, LABEL_JAVA, LABEL_RE2), S.zero_or_null(t1))),
            ("_n_hashtags", S.when(S.contains(t2, "#"), S.count(t2, HASHTAG), S.zero_or_null(t2))),
            # a hyphen counts only before an extending character, which is a rare one
            ("_n_dash", S.quick(S.rlike(S.col("_rare"), DASH + "|" + GRAPHEME_EXTEND), S.count(t2, DASHES), S.zero_or_null(t2))),
            ("_n_quote", _in_rare(QUOTE)),
            ("_n_ellipsis", gated(S.any_of(S.contains(t2, "…"), S.contains(t2, "...")), t2, family_pattern("ellipsis"))),
            ("_n_html", gated(S.contains(t2, "&amp;"), t2, "&amp;")),
            ("_n_devlog", _by_anchors("_n_devlog", S.count(t2, family_pattern_fast("devlog"), family_pattern("devlog")))),
            ("_n_buzz", _by_anchors("_n_buzz", S.count(t2, family_pattern_fast("buzzword"), family_pattern("buzzword")))),
            ("_n_negative", gated(S.any_of(*[S.contains(t2, p) for p in reduce_family(lexicon.NEGATIVE_BUZZWORD)]),
                                  t2, family_pattern("negative"))),
            ("_n_not_just", _by_anchors("_n_not_just", S.count(t2, family_pattern_fast("not_just"), family_pattern("not_just")))),
            ("_n_backstory", _by_anchors("_n_backstory", S.count(t2, family_pattern_fast("backstory"), family_pattern("backstory")))),
            ("_n_perspective", S.count(t2, family_pattern("perspective"))),
            ("_n_fancy", gated(S.contains(t2, "("), t2, family_pattern("fancy"))),
        ]
    ]


def metric_exprs(md_total: str = "_md_total") -> list[tuple[str, S.E]]:
    x = S.col
    d = S.as_double
    sent = x("_n_sent")
    return [
        ("emoji_rate", S.div(d(S.mul(x("_n_emoji"), lexicon.EMOJI_RATE_FACTOR)), d(sent))),
        (
            "buzzword_rate",
            S.div(d(S.mul(S.sub(x("_n_buzz"), x("_n_negative")), lexicon.BUZZWORD_RATE_FACTOR)), d(sent)),
        ),
        ("not_just_count", d(x("_n_not_just"))),
        ("html_escape_count", d(x("_n_html"))),
        ("devlog_count", d(x("_n_devlog"))),
        ("backstory_count", d(x("_n_backstory"))),
        ("incorrect_perspective_count", d(x("_n_perspective"))),
        ("mr_fancy_pants", d(x("_n_fancy"))),
        ("irregular_ellipsis", d(x("_n_ellipsis"))),
        ("irregular_quotations", d(x("_n_quote"))),
        ("irregular_dashes", d(x("_n_dash"))),
        ("irregular_markdown", d(x(md_total))),
        ("irregular_arrows", d(x("_n_arrow"))),
        ("labels", d(x("_n_labels"))),
        ("hashtags", d(x("_n_hashtags"))),
    ]


def metric_steps(text: str = "text", with_markdown: bool = True,
                 lexicons: dict[str, list[str]] | None = None) -> S.Steps:
    steps = normalize_steps(text) + scan_steps(lexicons) + _emoji_steps() + count_steps(lexicons)
    if with_markdown:
        steps = steps + md.markdown_steps(text)
        exprs = metric_exprs()
    else:
        exprs = [(n, e) if n != "irregular_markdown" else (n, S.lit(0.0)) for n, e in metric_exprs()]
    steps.append(exprs + [("sentence_count", S.col("_n_sent"))])
    return steps


def helper_columns() -> list[str]:
    names = ["_t1", "_t2", "_emoji_g", "_n_emoji", "_n_arrow"] + [n for n, _ in scan_steps()[0]] + [n for n, _ in count_steps()[0]] + md.markdown_columns()
    return names


def with_text_metrics(df: DataFrame, text: str = "text", keep_sentence_count: bool = True,
                      rebalance: int = 0, lexicons: dict[str, list[str]] | None = None,
                      metrics: list[str] | None = None) -> DataFrame:
    """``df`` plus the fifteen metric columns (``double``) in record order.

    A null text gives null metrics (the sentence count alone is 1). The rows
    are measured where they are read; only with ``rebalance`` are they first
    spread round-robin over that many partitions (for a scan of one big row
    group, which is read by one task: this shuffles the text).
    ``lexicons`` maps phrase-family names (``buzzword``, ``negative``,
    ``fancy``, ``not_just``, ``devlog``, ``ellipsis``, ``perspective``,
    ``backstory``) to replacement phrase lists. ``metrics`` limits the
    output to some of the fifteen (the passes they do not need are pruned)."""
    emoji_mod.emoji_table(df.sparkSession)
    src = df.repartition(rebalance) if rebalance else df
    steps = metric_steps(text, lexicons=lexicons)
    out = S.apply_steps(src, steps)
    wanted = list(metrics) if metrics is not None else METRICS
    unknown = set(wanted) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    produced = wanted + (["sentence_count"] if keep_sentence_count else [])
    # A barrier: the metrics leave through a one-row generator, so a later
    # filter on a metric stays above it. Pushed down, such a filter would be
    # rewritten through every step of the chain (several references per
    # step), which makes planning and generated code explode. Filters on
    # the passed-through columns still reach the scan.
    return out.select(*src.columns, F.inline(F.array(F.struct(*[F.col(c) for c in produced]))))
