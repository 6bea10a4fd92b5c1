"""The three text states.

* T0, raw: read by the markup counter and the bullet count.
* T1 = ASCII lower-case, Unicode-trimmed, one left-to-right pass of
  ``"\\n\\n" -> "\\n"``: read by the sentence count and the label count.
* T2 = T1 with newlines turned into spaces, then one pass of
  ``"  " -> " "``: read by every other counter.

Lower-casing is ASCII only (``translate``), because ``lower`` would also
change letters such as ``À``; trimming strips every Unicode White_Space
character, which ``trim`` without a set does not.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .charclass import WS, WS_CHARS


def ascii_lower(col: Column) -> Column:
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def unicode_trim(col: Column) -> Column:
    return F.trim(col, F.lit(WS_CHARS))


def collapse_blank_lines(col: Column) -> Column:
    return F.replace(col, F.lit("\n\n"), F.lit("\n"))


def flatten_lines(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))


def t1(col: Column) -> Column:
    return collapse_blank_lines(unicode_trim(ascii_lower(col)))


def t2_from_t1(col: Column) -> Column:
    return flatten_lines(col)


# Segment and word patterns shared with the SQL twins.
SENTENCE_SEGMENT = f"[^.!?\\n{WS}][^.!?\\n]*"
SENTENCE_SPLIT = "[.!?\\n]"
NON_BLANK = f"[^{WS}]"
WORD_SPLIT = f"[{WS}]+"


def sentence_count(t1_col: Column) -> Column:
    """max(1, number of non-blank segments between . ! ? and newline)."""
    return F.greatest(F.lit(1), F.regexp_count(t1_col, F.lit(SENTENCE_SEGMENT)))


def split_sentences(t1_col: Column) -> Column:
    """Array of the non-blank sentence segments, in order."""
    return F.filter(F.split(t1_col, SENTENCE_SPLIT), lambda s: s.rlike(NON_BLANK))


def split_words(t2_col: Column) -> Column:
    """Array of the whitespace-separated words, in order."""
    return F.filter(F.split(t2_col, WORD_SPLIT), lambda w: w != F.lit(""))


def split_lines(t1_col: Column) -> Column:
    """Array of the lines, each without one trailing carriage return."""
    return F.transform(F.split(t1_col, "\n"), lambda s: F.regexp_replace(s, "\r\\z", ""))


def graphemes(col: Column) -> Column:
    """Array of extended grapheme clusters."""
    return F.regexp_extract_all(col, F.lit("\\X"), F.lit(0))
