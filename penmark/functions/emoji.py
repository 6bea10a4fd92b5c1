"""Emoji counting: one per extended grapheme cluster that is an emoji.

The emoji table is built by rule from the ICU copy that ships with Spark:
every RGI emoji sequence, plus each variant with any subset of its U+FE0F
presentation selectors removed (unqualified forms such as a bare ``©``
count), minus the five bare skin-tone modifiers. It is built once per
driver process and embedded in the plan as one anchored prefix-trie regex
(a 5,000-entry ``IN`` list costs seconds of planning per query; the trie
is one literal, compiled once per task).

The count runs natively: a cheap ``rlike`` gate on a coarse code-point
range, then ``regexp_extract_all`` of the graphemes that start in that
range (plus keycaps) and the trie lookup on each.
"""

from __future__ import annotations

import itertools
import threading

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# First code points of every emoji sequence lie in this range (checked when
# the table is built); keycaps start with # * or a digit and are matched
# on their own.
COARSE = r"[\x{A9}\x{AE}\x{203C}-\x{3299}\x{1F000}-\x{1FAFF}]"
KEYCAP = r"(?=[#*0-9]\x{FE0F}?\x{20E3})\X"  # the whole grapheme, extenders included
GATE = r"[\x{A9}\x{AE}\x{203C}-\x{3299}\x{1F000}-\x{1FAFF}\x{20E3}]"
EXTRACT = KEYCAP + "|(?=" + COARSE + r")\X"

SKIN_TONES = {chr(c) for c in range(0x1F3FB, 0x1F400)}

_lock = threading.Lock()
_table: frozenset[str] | None = None


def _in_coarse(cp: int) -> bool:
    return cp in (0xA9, 0xAE) or 0x203C <= cp <= 0x3299 or 0x1F000 <= cp <= 0x1FAFF


def build_table(spark: SparkSession) -> frozenset[str]:
    """All strings the emoji lookup accepts (built on the driver from ICU)."""
    jvm = spark.sparkContext._jvm
    uset = jvm.com.ibm.icu.text.UnicodeSet("[:RGI_Emoji:]")
    it = uset.iterator()
    base = []
    while it.hasNext():
        base.append(str(it.next()))
    out = set()
    for s in base:
        pos = [i for i, c in enumerate(s) if c == "️"]
        for r in range(len(pos) + 1):
            for drop in itertools.combinations(pos, r):
                v = "".join(c for i, c in enumerate(s) if i not in drop)
                if v and v not in SKIN_TONES:
                    out.add(v)
    for s in out:
        first = ord(s[0])
        if not (_in_coarse(first) or (s[0] in "#*0123456789" and s.endswith("⃣"))):
            raise ValueError(f"emoji {s!r} starts outside the coarse range")
    return frozenset(out)


def emoji_table(spark: SparkSession | None = None) -> frozenset[str]:
    global _table
    with _lock:
        if _table is None:
            spark = spark or SparkSession.getActiveSession()
            if spark is None:
                raise RuntimeError("an active SparkSession is needed to build the emoji table")
            _table = build_table(spark)
        return _table


_lookup_cache: dict[frozenset, str] = {}


def lookup_regex(table: frozenset[str]) -> str:
    r"""``^(?:trie)\z`` matching exactly the strings of the table."""
    if table not in _lookup_cache:
        from .phrases import trie_regex

        _lookup_cache[table] = "^(?:" + trie_regex(sorted(table)) + ")\\z"
    return _lookup_cache[table]


ZWJ_RUN = "\u200d\u200d"


def _uax29_joiner_breaks(t2: Column) -> Column:
    """Java's ``\\X`` joins a pictograph after two or more joiners to the
    preceding grapheme; UAX #29 does not (a joiner only links a pictograph
    to a pictograph directly before it). A control character after such a
    run restores that break; nothing after the run can belong to an emoji
    anyway, so no other count changes."""
    fixed = F.regexp_replace(t2, F.lit("(\\x{200D}{2,})"), F.lit("$1\u0001"))
    return F.when(t2.contains(ZWJ_RUN), fixed).otherwise(t2)


def emoji_graphemes(t2: Column, table: frozenset[str] | None = None, rare: Column | None = None) -> Column:
    """The emoji graphemes of ``t2``, in order (an array; null for null).
    ``rare``, if given, holds at least the characters of the gate in ``t2``."""
    table = table if table is not None else emoji_table()
    rx = lookup_regex(table)
    graph = F.regexp_extract_all(_uax29_joiner_breaks(t2), F.lit(EXTRACT), F.lit(0))
    hits = F.filter(graph, lambda g: g.rlike(rx))
    empty = F.array().cast("array<string>")
    return F.when(t2.isNull(), F.lit(None).cast("array<string>")).when((t2 if rare is None else rare).rlike(GATE), hits).otherwise(empty)


def emoji_count(t2: Column, table: frozenset[str] | None = None) -> Column:
    """Number of emoji graphemes in ``t2`` (an int)."""
    g = emoji_graphemes(t2, table)
    return F.when(g.isNull(), F.lit(None)).otherwise(F.size(g))


_single_cp_class: str | None = None


def single_codepoint_class() -> str:
    """Regex class of one-code-point emoji for the SQL twin, which has no
    grapheme support and counts code points. Built by rule without Spark
    (Emoji property minus keycap bases, regional indicators and skin tones,
    from the ``regex`` module), so the twin can be written before any
    session exists. It is a superset of the single-code-point entries of
    the ICU table (newer Unicode); the fixtures use only shared ones."""
    global _single_cp_class
    if _single_cp_class is None:
        import regex

        rx = regex.compile(r"\p{Emoji}")
        cps = [
            c for c in range(0x80, 0x20000)
            if not 0xD800 <= c <= 0xDFFF and not 0x1F1E6 <= c <= 0x1F1FF and not 0x1F3FB <= c <= 0x1F3FF
            and rx.match(chr(c))
        ]
        ranges: list[list[int]] = []
        for cp in cps:
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1][1] = cp
            else:
                ranges.append([cp, cp])
        body = "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
        _single_cp_class = "[" + body + "]"
    return _single_cp_class
