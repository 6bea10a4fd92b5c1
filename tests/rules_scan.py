"""
used only to cross-check the native expressions on random strings.
Graphemes come from the ``regex`` module's ``\\X``."""

from __future__ import annotations

import regex

from penmark.functions import lexicon

WHITE = set("\t\n\x0b\x0c\r \x85\xa0 " + "".join(chr(c) for c in range(0x2000, 0x200B)) + "    　")
GRAPHEME = regex.compile(r"\X")
ALPHABETIC = regex.compile(r"\p{Alphabetic}")  # the derived property, not str.isalpha (misses Nl, Other_Alphabetic)


def t1(text: str) -> str:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    i, j = 0, len(low)
    while i < j and low[i] in WHITE:
        i += 1
    while j > i and low[j - 1] in WHITE:
        j -= 1
    return low[i:j].replace("\n\n", "\n")


def t2(t1_text: str) -> str:
    return t1_text.replace("\n", " ").replace("  ", " ")


def sentences(t: str) -> int:
    segs, cur = [], []
    for c in t:
        if c in ".!?\n":
            segs.append("".join(cur))
            cur = []
        else:
            cur.append(c)
    segs.append("".join(cur))
    return max(1, sum(1 for s in segs if any(c not in WHITE for c in s)))


def labels(t: str) -> int:
    n = 0
    for line in t.split("\n"):
        if line.endswith("\r"):
            line = line[:-1]
        if ":" in line:
            head = line.split(":", 1)[0]
            stripped = "".join(c for c in head if c not in WHITE)
            if stripped and all(ALPHABETIC.match(c) or c in WHITE for c in head):
                n += 1
    return n


def hashtags(t: str) -> int:
    words, cur = [], []
    for c in t:
        if c in WHITE:
            if cur:
                words.append("".join(cur))
            cur = []
        else:
            cur.append(c)
    if cur:
        words.append("".join(cur))
    return sum(1 for w in words if w.startswith("#") and len(w.encode()) > 1)


def grapheme_counts(t: str, table) -> dict:
    out = {"emoji": 0, "dash": 0, "arrow": 0, "quote": 0}
    for g in GRAPHEME.findall(t):
        if g in table:
            out["emoji"] += 1
            continue
        for i, c in enumerate(g):
            if c in lexicon.DASH_CHARS:
                out["dash"] += 1
            elif c in lexicon.ARROW_CHARS:
                out["arrow"] += 1
            elif c in lexicon.QUOTE_CHARS:
                out["quote"] += 1
            elif c == "-" and i + 1 < len(g) and g[i + 1] not in WHITE:
                out["dash"] += 1
    return out


def earliest_end(text: str, phrases: list[str]) -> int:
    pos, n = 0, 0
    while True:
        best = None
        for p in phrases:
            k = text.find(p, pos)
            if k >= 0 and (best is None or k + len(p) < best):
                best = k + len(p)
        if best is None:
            return n
        n += 1
        pos = best
