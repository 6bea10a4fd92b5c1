"""Multi-phrase counting as one native regex per family.

The counting rule is "non-overlapping, earliest-ending match first, resume
after it", which yields the largest set of disjoint occurrences. Replacing
a phrase by a shorter phrase of the same family that it contains can never
shrink that set, so every phrase that contains another one is dropped.
Among the remaining phrases no occurrence contains another, hence
leftmost order equals earliest-end order and a plain leftmost regex scan
(``regexp_count``) gives the same count. The alternation is emitted as a
prefix trie, which the regex engine walks far faster than a flat list.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon
from .charclass import escape


def reduce_family(phrases: list[str]) -> list[str]:
    """Unique phrases, minus every phrase that contains another one."""
    uniq = list(dict.fromkeys(p for p in phrases if p))
    return [p for p in uniq if not any(q != p and q in p for q in uniq)]


def trie_regex(phrases: list[str]) -> str:
    """Prefix-trie alternation matching exactly the given (reduced) phrases."""
    if not phrases:
        raise ValueError("empty phrase family")
    trie: dict = {}
    for p in phrases:
        node = trie
        for ch in p:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node: dict) -> str:
        branches = []
        for ch in sorted(node):
            if ch == "":
                branches.append("")
            else:
                branches.append(escape(ch) + emit(node[ch]))
        if len(branches) == 1:
            return branches[0]
        # After reduction no phrase is a prefix of another, so "" never
        # shares a node with other branches; keep it safe anyway.
        body = "|".join(b for b in branches if b)
        return f"(?:{body})" + ("?" if "" in branches else "")

    return emit(trie)


@lru_cache(maxsize=None)
def family_pattern(family: str) -> str:
    return trie_regex(reduce_family(lexicon.FAMILIES[family]))


@lru_cache(maxsize=None)
def family_pattern_fast(family: str) -> str:
    """The same trie behind a look-ahead on the possible first characters:
    identical matches, but most positions fail after one class test (Java
    only; RE2 has no look-ahead, so SQL twins use :func:`family_pattern`)."""
    firsts = sorted({p[0] for p in family_phrases(family)})
    cls = "".join("\\" + c if c in "\\^-[]&" else c for c in firsts)
    return f"(?=[{cls}])" + family_pattern(family)


# Characters from frequent to rare in European prose; any other is rarer.
FREQUENCY = " etaoinsrhldcumfpgwybvkxjqz"


def _anchors(phrases: list[str]) -> dict[str, str]:
    """One character of each phrase, of few and rare ones: frequent characters
    are given up as long as every phrase keeps another."""
    rank = {c: len(FREQUENCY) - i for i, c in enumerate(FREQUENCY)}
    kept = {c for p in phrases for c in p}
    for c in FREQUENCY:
        if all(set(p) & (kept - {c}) for p in phrases):
            kept.discard(c)
    return {p: min(set(p) & kept, key=lambda c: (rank.get(c, 0), c)) for p in phrases}


def anchor_pattern(phrases: list[str]) -> str:
    """One match, of one character, at the anchor of every occurrence (Java
    only). Each occurrence holds its anchor, so no match means that nothing
    occurs, and one match that all that occurs shares a character: the
    non-overlapping count is then 0 or 1. Nearly every position fails after
    one class test, which the trie of a large family does not offer."""
    if not phrases:
        raise ValueError("empty phrase family")
    tails: dict = {}
    for p, c in sorted(_anchors(phrases).items()):
        tails.setdefault(c, {}).setdefault(p[p.index(c) + 1 :], []).append(p)
    branches = []
    for c, by_tail in sorted(tails.items()):
        ends = [escape(tail) + "(?<=" + "|".join(escape(p) for p in whole) + ")" for tail, whole in sorted(by_tail.items())]
        branches.append(escape(c) + "(?:" + "|".join(ends) + ")")
    cls = "[" + "".join("\\" + c if c in "\\^-[]&" else c for c in sorted(tails)) + "]"
    return f"(?={cls})(?={'|'.join(branches)}){cls}"


@lru_cache(maxsize=None)
def family_anchor_pattern(family: str) -> str:
    return anchor_pattern(family_phrases(family))


def family_phrases(family: str) -> list[str]:
    return reduce_family(lexicon.FAMILIES[family])


def validate_negative(positive: list[str], negative: list[str]) -> None:
    """Each negative phrase must contain a positive one, so that the
    difference of the two counts can never go below zero."""
    pos = reduce_family(positive)
    for n in negative:
        if not any(p in n for p in pos):
            raise ValueError(f"negative phrase {n!r} contains no positive phrase")


validate_negative(lexicon.BUZZWORD, lexicon.NEGATIVE_BUZZWORD)


def phrase_count(col: Column, family: str) -> Column:
    """Non-overlapping occurrences of a phrase family in ``col`` (an int)."""
    return F.regexp_count(col, F.lit(family_pattern(family)))


def phrase_count_custom(col: Column, phrases: list[str]) -> Column:
    """Same rule for a user-supplied lexicon."""
    return F.regexp_count(col, F.lit(trie_regex(reduce_family(phrases))))
