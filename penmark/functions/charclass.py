"""Character classes and regex building blocks.

Every pattern here is written in the common subset of Java regex (what
Spark runs) and RE2 (what DuckDB runs), so the same string serves the
Spark operator and its SQL twin: explicit classes, no look-around, no
back-references, no multi-line flag, ``\\z`` for end of text.
"""

from __future__ import annotations

from . import lexicon

# Unicode White_Space, as a regex class body and as plain characters.
WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# The same without the newline.
WSN = r"\t\x{0B}-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS_CHARS = (
    "\t\n\x0b\x0c\r \x85\xa0 "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "    　"
)

# ASCII whitespace as Java's \s reads it, spelled out so RE2 agrees.
SP = r"\t\n\x{0B}\x{0C}\r "


def cls(chars: str) -> str:
    """Regex class matching any one of ``chars`` (written as \\x{..})."""
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in chars) + "]"


def ranges_cls(chars: str) -> str:
    """Like :func:`cls`, with runs of consecutive code points as ranges
    (fewer alternatives for the regex engine to test per position)."""
    cps = sorted({ord(c) for c in chars})
    parts, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        a, b = cps[i], cps[j]
        parts.append(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}")
        i = j + 1
    return "[" + "".join(parts) + "]"


DASH = ranges_cls(lexicon.DASH_CHARS)
QUOTE = cls(lexicon.QUOTE_CHARS)
# Characters that extend a grapheme after an ASCII hyphen: combining
# marks, ZWNJ, ZWJ, skin-tone modifiers, halfwidth sound marks, tags.
GRAPHEME_EXTEND = r"[\p{M}\x{200C}\x{200D}\x{1F3FB}-\x{1F3FF}\x{FF9E}\x{FF9F}\x{E0020}-\x{E007F}]"
HYPHEN_IN_GRAPHEME = "-" + GRAPHEME_EXTEND

# Runs of characters below U+0300 other than the two emoji among them: none of
# the dashes, quotes, arrows, emoji and extending characters is in one.
COMMON_RUN = r"[\x00-\xA8\xAA-\xAD\xAF-\x{2FF}]+"

_META = set("\\.^$|?*+()[]{}")


def escape(text: str) -> str:
    """Escape ASCII regex metacharacters only (same reading in Java and RE2)."""
    return "".join("\\" + c if c in _META else c for c in text)


def sql_str(text: str) -> str:
    """Quote a Python string as a standard SQL literal (DuckDB reads it as is)."""
    if "\n" in text:
        parts = text.split("\n")
        return " || chr(10) || ".join(sql_str(p) for p in parts)
    return "'" + text.replace("'", "''") + "'"
