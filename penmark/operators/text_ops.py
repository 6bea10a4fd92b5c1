"""Row-producing text operators: sentences, words, lines, graphemes,
phrase hits and the per-construct markup breakdown.

All are projections plus ``posexplode``/``explode`` (no shuffle), except
``phrase_hits``, a partial aggregate over (family, phrase).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions import spec as S
from ..functions.blocks import COUNTS, block_counts
from ..functions.metrics import normalize_steps
from ..functions.normalize import graphemes, split_lines, split_sentences, split_words
from ..functions.phrases import anchor_pattern, family_anchor_pattern, family_pattern, reduce_family, trie_regex

FAMILY_ORDER = ["buzzword", "negative", "fancy", "not_just", "devlog", "ellipsis", "perspective", "backstory"]


def with_text_states(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus ``_t1`` (lower-cased, trimmed, blank lines collapsed) and
    ``_t2`` (flattened to one line)."""
    return S.apply_steps(df, normalize_steps(text))


def _explode(df: DataFrame, keys: list[str], arr, name: str) -> DataFrame:
    return df.select(*keys, F.posexplode(arr).alias("pos", name))


def sentences(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, pos, sentence): non-blank segments between . ! ? and newline."""
    return _explode(with_text_states(df, text), keys, split_sentences(F.col("_t1")), "sentence")


def words(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, pos, word): whitespace-separated words of the flattened text."""
    return _explode(with_text_states(df, text), keys, split_words(F.col("_t2")), "word")


def lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, pos, line): lines of the normalised text, trailing CR dropped."""
    t = with_text_states(df, text)
    arr = F.when(F.col("_t1") == "", F.array().cast("array<string>")).otherwise(split_lines(F.col("_t1")))
    return _explode(t, keys, arr, "line")


def grapheme_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, pos, grapheme): extended grapheme clusters of the raw text."""
    return _explode(df, keys, graphemes(F.col(text)), "grapheme")


def phrase_hits(df: DataFrame, text: str = "text", lexicons: dict[str, list[str]] | None = None) -> DataFrame:
    """(family, phrase, n): which phrases drive the counts, over the whole
    table. Exact per phrase, because the reduced families are unambiguous."""
    t = with_text_states(df.select(text), text)
    if lexicons:
        pats = {f: (trie_regex(reduce_family(p)), anchor_pattern(reduce_family(p))) for f, p in lexicons.items()}
    else:
        pats = {f: (family_pattern(f), family_anchor_pattern(f)) for f in FAMILY_ORDER}
    # the trie runs only where a phrase is anchored
    none = F.array().cast("array<string>")
    hits = [
        F.struct(
            F.lit(f).alias("family"),
            F.when(F.col("_t2").rlike(at), F.regexp_extract_all("_t2", F.lit(p), F.lit(0))).otherwise(none).alias("hits"),
        )
        for f, (p, at) in pats.items()
    ]
    ex = t.select(F.explode(F.array(*hits)).alias("h")).select(
        F.col("h.family").alias("family"), F.explode("h.hits").alias("phrase")
    )
    return ex.groupBy("family", "phrase").agg(F.count(F.lit(1)).alias("n"))


MD_PARTS = ["fbt", "ftl", "setext", "atx", "rule", "quote", "indented", "image", "link", "autolink",
            "html", "strong", "emphasis", "bullet", "total"]


def markdown_breakdown(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, md_<construct>..., md_total): markup counts per construct."""
    out = S.apply_steps(df, md.markdown_steps(text))
    return out.select(*keys, *[F.col(f"_md_{p}").cast("long").alias(f"md_{p}") for p in MD_PARTS])


def markup_events(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, fences, indented, quotes, ..., total): markup events with block
    state (see ``functions.blocks``). All null for a null text."""
    out = df.select(*keys, block_counts(F.col(text)).alias("_b"))
    return out.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in [*COUNTS, "bullet", "total"]])
