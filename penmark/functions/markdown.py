"""Markup markers on the raw text, as native regex passes.

Counted: headings (ATX and setext), thematic breaks, block-quote runs,
code blocks (fenced and indented), emphasis, strong emphasis, links,
images, autolinks, inline HTML tags and comments, plus every ``•``.
Lists, inline code and paragraphs count 0; the optional extensions
(tables, strikethrough, math, footnotes, task lists) are off and count 0.

How: fences are counted and masked first; then every line of the masked
text is given its own two newlines (``"\\n" + replace(a, "\\n", "\\n\\n") +
"\\n"``), so the line patterns need no anchors or look-around and
neighbouring lines never compete for a newline. Setext headings are
counted and masked, then ATX headings, rules, quote runs and indented runs
are counted. Inline constructs are counted on the fence-masked text in a
fixed order (code spans masked first, not counted), each masked after it
is counted. Each stage is gated by a cheap ``contains`` on its trigger
characters.

Backslash escapes of ASCII punctuation are honoured in inline text.

Known gaps against a full CommonMark parser: emphasis across lines,
markup inside link text, nested quotes and lists, reference links, lazy
continuation lines, escapes in block markers, indented text under list
items, and HTML blocks counted per tag instead of per line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import spec as S

SP = r"\t\n\x{0B}\x{0C}\r "  # ASCII whitespace, spelled out for both engines

FENCE_BACKTICK = r"(?:^|\n) {0,3}```[^`\n]*(?s:.*?)(?:\n {0,3}```+[ \t]*|\z)"
FENCE_TILDE = r"(?:^|\n) {0,3}~~~[^\n]*(?s:.*?)(?:\n {0,3}~~~+[ \t]*|\z)"
SETEXT = r"\n {0,3}[^" + SP + r"#>*+=~`\-][^\n]*\n\n {0,3}(?:=+|-+)[ \t]*\n"
ATX = r"\n {0,3}#{1,6}(?:[ \t][^\n]*)?\n"
RULE = r"\n {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\n"
QUOTE_RUN = r"\n {0,3}>[^\n]*\n(?:\n {0,3}>[^\n]*\n)*"
INDENTED_RUN = r"(?:^|\n[ \t]*\n)(?:\n(?: {4}|\t)[ \t]*[^" + SP + r"][^\n]*\n)+"
# The same for Java, possessive: a repeated group would recurse once a line
# there and overflow the stack on long runs.
JAVA = {
    RULE: r"\n {0,3}(?:(?:\*[ \t]*+){3,}+|(?:-[ \t]*+){3,}+|(?:_[ \t]*+){3,}+)\n",
    QUOTE_RUN: r"\n {0,3}>[^\n]*\n(?:\n {0,3}>[^\n]*\n)*+",
    INDENTED_RUN: r"(?:^|\n[ \t]*\n)(?:\n(?: {4}|\t)[ \t]*[^" + SP + r"][^\n]*\n)++",
}
CODE_SPAN = r"`+[^`\n]+`+"
ESCAPE = r"\\[!-/:-@\[-`{-~]"  # backslash + ASCII punctuation: a literal character
IMAGE = r"!\[[^\[\]\n]*\]\([^()" + SP + r"]*(?:[ \t]+" + '"' + r'[^"\n]*' + '"' + r")?\)"
LINK = r"\[[^\[\]\n]*\]\([^()" + SP + r"]*(?:[ \t]+" + '"' + r'[^"\n]*' + '"' + r")?\)"
AUTOLINK = r"<[A-Za-z][A-Za-z0-9+.\-]{1,31}:[^" + SP + r"<>]*>"
HTML = (
    r"<!--(?s:.*?)-->|</?[A-Za-z][A-Za-z0-9\-]*(?:[" + SP + r"][^<>]*)?/?>|<![A-Za-z][^<>]*>"
)
STRONG = (
    r"\*\*[^" + SP + r"*](?:[^*\n]*[^" + SP + r"*])?\*\*"
    r"|__[^" + SP + r"_](?:[^_\n]*[^" + SP + r"_])?__"
)
EMPHASIS = (
    r"\*[^" + SP + r"*](?:[^*\n]*[^" + SP + r"*])?\*"
    r"|(?:^|[^\pL\pN_])_[^" + SP + r"_](?:[^_\n]*[^" + SP + r"_])?_"
)
BULLET = "•"
# Every block construct needs a line that starts (after up to three spaces)
# with one of these characters, or an indented line.
BLOCK_LINE = r"(?: {0,3}[#>=*_\-]| {4}|\t)"
BLOCK_GATE = r"(?:^|\n)" + BLOCK_LINE

MARKDOWN_PARTS = [
    "md_fence", "md_setext", "md_atx", "md_rule", "md_quote", "md_indented",
    "md_image", "md_link", "md_autolink", "md_html", "md_strong",
    "md_emphasis", "md_bullet",
]


def markdown_steps(t0: str = "text", prefix: str = "_md_") -> S.Steps:
    """Levels of columns ending in ``{prefix}total`` (an int)."""
    p = prefix
    x = S.col
    has_fence = S.any_of(S.contains(x(t0), "```"), S.contains(x(t0), "~~~"))
    zero = S.lit(0)

    def gated(cond, expr, other):
        return S.when(cond, expr, other)

    inline = [
        ("image", IMAGE, "]("),
        ("link", LINK, "]("),
        ("autolink", AUTOLINK, "<"),
        ("html", HTML, "<"),
        ("strong", STRONG, None),
        ("emphasis", EMPHASIS, None),
    ]

    steps: S.Steps = [
        [
            (f"{p}fbt", gated(has_fence, S.count(x(t0), FENCE_BACKTICK), zero)),
            (f"{p}a1", gated(has_fence, S.rreplace(x(t0), FENCE_BACKTICK, "\n"), x(t0))),
            (f"{p}bullet", S.quick(S.contains(x(t0), BULLET), S.count(x(t0), BULLET), S.zero_or_null(x(t0)))),
        ],
        [
            (f"{p}ftl", gated(has_fence, S.count(x(f"{p}a1"), FENCE_TILDE), zero)),
            (f"{p}a", gated(has_fence, S.rreplace(x(f"{p}a1"), FENCE_TILDE, "\n"), x(f"{p}a1"))),
        ],
        [
            (f"{p}blk", S.native(_block_gate, lambda sql: S.to_sql(S.rlike(S.col(sql), BLOCK_GATE)), x(f"{p}a"))),
            (f"{p}i0", gated(S.contains(x(f"{p}a"), "`"), S.rreplace(x(f"{p}a"), CODE_SPAN, "x"), x(f"{p}a"))),
        ],
        [
            (
                f"{p}d",
                gated(
                    x(f"{p}blk"),
                    S.concat(S.lit("\n"), S.replace(x(f"{p}a"), "\n", "\n\n"), S.lit("\n")),
                    S.lit(""),
                ),
            ),
        ],
        [
            (f"{p}setext", S.count(x(f"{p}d"), SETEXT)),
            (f"{p}d2", S.rreplace(x(f"{p}d"), SETEXT, "\nx\n")),
        ],
        [
            (f"{p}atx", S.count(x(f"{p}d2"), ATX)),
            (f"{p}rule", S.count(x(f"{p}d2"), JAVA[RULE], RULE)),
            (f"{p}quote", S.count(x(f"{p}d2"), JAVA[QUOTE_RUN], QUOTE_RUN)),
            (f"{p}indented", S.count(x(f"{p}d2"), JAVA[INDENTED_RUN], INDENTED_RUN)),
        ],
    ]
    # backslash escapes make the next punctuation literal (after code spans,
    # inside which a backslash is itself literal)
    steps.append([(f"{p}ie", gated(S.contains(x(f"{p}i0"), "\\"), S.rreplace(x(f"{p}i0"), ESCAPE, "x"), x(f"{p}i0")))])
    prev = f"{p}ie"
    for i, (name, pat, trig) in enumerate(inline, start=1):
        if name == "html":
            # the twin's engine has no such search, and takes the text as it is
            steps.append([(f"{p}hc", S.native(_open_comments, lambda sql: sql, x(prev)))])
            prev = f"{p}hc"
        src = x(prev)
        if name in ("strong", "emphasis"):
            cond = S.any_of(S.contains(src, "*"), S.contains(src, "_"))
        else:
            cond = S.contains(src, trig)
        cur = f"{p}i{i}"
        steps.append(
            [
                (f"{p}{name}", gated(cond, S.count(src, pat), zero)),
                (cur, gated(cond, S.rreplace(src, pat, "x"), src)),
            ]
        )
        prev = cur
    total = S.add(
        x(f"{p}fbt"), x(f"{p}ftl"), x(f"{p}setext"), x(f"{p}atx"), x(f"{p}rule"),
        x(f"{p}quote"), x(f"{p}indented"), x(f"{p}image"), x(f"{p}link"),
        x(f"{p}autolink"), x(f"{p}html"), x(f"{p}strong"), x(f"{p}emphasis"),
        x(f"{p}bullet"),
    )
    steps.append([(f"{p}total", total)])
    return steps


def _block_gate(text: Column) -> Column:
    """``BLOCK_GATE``, its two anchors apart: the one is tried once, the other fails at every character but a newline."""
    return text.rlike("^" + BLOCK_LINE) | text.rlike("\\n" + BLOCK_LINE)


def _open_comments(text: Column) -> Column:
    """Comments that no ``-->`` follows are spelled ``<!-.``: they count
    nothing, and the comment pattern need not search to the end from each."""
    tail = F.substring_index(text, "-->", -1)
    head = text.substr(F.lit(1), F.length(text) - F.length(tail))
    return F.when(text.contains("<!--"), F.concat(head, F.replace(tail, F.lit("<!--"), F.lit("<!-.")))).otherwise(text)


def markdown_columns(prefix: str = "_md_") -> list[str]:
    names = ["fbt", "a1", "bullet", "ftl", "a", "blk", "i0", "ie", "hc", "d", "setext", "d2", "atx",
             "rule", "quote", "indented", "image", "link", "autolink", "html", "strong",
             "emphasis", "total"] + [f"i{i}" for i in range(1, 7)]
    return [prefix + n for n in names]
