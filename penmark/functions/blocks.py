"""Markup events with block state: one native fold over the lines of a text.

``markdown`` counts by patterns over the whole text and keeps no state
between lines. Here every line is classed on its own (quote depth, indent,
list marker, fence, heading, rule, HTML start, inline events), and one
``aggregate`` walks the lines with the open containers as its state. So HTML
blocks count once per line, each level of a nested quote once, text that is
indented under a list item is no code, a lazy line continues its paragraph,
and nothing inside a fence, an HTML block or code counts as inline markup.

Per line: quote markers first (up to three spaces, ``>``, a space), then the
indent, then at most one list marker. Inline events are those of
``markdown``, counted line by line on paragraphs and headings.

Defined cases: a null text gives null; an empty one zeros; a tab is four
spaces; ``\\r\\n`` and ``\\r`` end lines as ``\\n`` does; lines of an HTML
block count even where blank. Gaps against a full parser: quotes inside list
items, two list markers on one line, reference links, inline markup that
spans lines.

The state holds the content columns of the open items; it is as deep as the
items are nested, not as long as the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import markdown as md

# HTML tags that open a block of their own (CommonMark 0.31, start condition 6)
BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link "
    "main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead "
    "title tr track ul"
).split()
# End of fixed values

# possessive: a repeated group would recurse in Java and overflow the stack on long lines
QUOTE = r"^(?: {0,3}> ?+)*+"
MARKER = r"^(?:[-+*]|[0-9]{1,9}[.)])(?: +|\z)"
RULE = r"^(?:(?:\* *+){3,}+|(?:- *+){3,}+|(?:_ *+){3,}+)\z"
UNDERLINE = r"^(?:=+|-+) *\z"
ATX = r"^#{1,6}(?: |\z)"
FENCE = r"^(?:(`{3,})[^`]*|(~{3,})[^\n]*)\z"
BARE = r"^(?:`{3,}|~{3,}) *\z"
RAW = "script|pre|style|textarea"
STARTS = {  # type: pattern of a line that starts an HTML block
    1: rf"(?i)^<(?:{RAW})(?:[ >]|\z)",
    2: r"^<!--",
    3: r"^<\?",
    4: r"^<![A-Za-z]",
    5: r"^<!\[CDATA\[",
    6: rf"(?i)^</?(?:{'|'.join(BLOCK_TAGS)})(?: |/?>|\z)",
    7: r"^(?:<[A-Za-z][A-Za-z0-9-]*+(?: +[A-Za-z_:][A-Za-z0-9_.:-]*+(?: *= *(?:[^ \"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*+ */?>|</[A-Za-z][A-Za-z0-9-]* *>) *\z",
}
ENDS = {1: rf"(?i)</(?:{RAW})>", 2: "-->", 3: r"\?>", 4: ">", 5: r"\]\]>"}  # 6 and 7 end at a blank line

COUNTS = ["fences", "indented", "quotes", "atx", "setext", "rules", "html_lines", "inline"]
IN_FENCE, IN_HTML, BLANK, SETEXT, MORE, CODE, HR, HEADING, OPENS_FENCE, OPENS_HTML, TEXT = range(11)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _with(lines: Column, had: list[str], **more: Callable[[Column], Column]) -> Column:
    return F.transform(lines, lambda x: F.struct(*[x[c].alias(c) for c in had], *[f(x).alias(c) for c, f in more.items()]))


def _int(c: Column) -> Column:
    return c.cast("int")


def _taken(pattern: str) -> Callable[[Column], Column]:
    """Counts a pattern and masks what it matched."""

    def take(x: Column) -> Column:
        n, src = F.regexp_count(x["src"], F.lit(pattern)), F.regexp_replace(x["src"], pattern, "x")
        return F.when(x["src"] == "", x).otherwise(F.struct(src.alias("src"), (x["n"] + n).alias("n")))

    return take


def _inline(lines: Column) -> Column:
    """Number of inline events of each line."""
    mark = r"[*_<\[`\\]"

    def masked(x: Column) -> Column:
        out = F.regexp_replace(F.regexp_replace(x, md.CODE_SPAN, "x"), md.ESCAPE, "x")
        return F.when(x.rlike(mark), out).otherwise(F.lit(""))

    out = F.transform(lines, lambda x: F.struct(masked(x).alias("src"), F.lit(0).alias("n")))
    for pattern in (md.IMAGE, md.LINK, md.AUTOLINK, md.HTML, md.STRONG, md.EMPHASIS):
        out = F.transform(out, _taken(pattern))
    return F.transform(out, lambda x: x["n"])


def _lines(text: Column) -> Column:
    """What each line says on its own."""
    lines = F.split(F.replace(text, F.lit("\t"), F.lit("    ")), r"\r\n|\r|\n")
    out = F.transform(lines, lambda x: F.struct(x.alias("line"), F.regexp_extract(x, QUOTE, 0).alias("prefix")))
    out = F.transform(
        out,
        lambda x: F.struct(
            x["line"].substr(F.length(x["prefix"]) + 1, F.length(x["line"])).alias("rest"),
            _int(F.length(x["prefix"]) - F.length(F.replace(x["prefix"], F.lit(">"), F.lit("")))).alias("depth"),
        ),
    )
    out = _with(out, ["rest", "depth"], body=lambda x: F.ltrim(x["rest"]))
    out = _with(
        out, ["rest", "depth", "body"],
        indent=lambda x: F.length(x["rest"]) - F.length(x["body"]),
        rule=lambda x: x["body"].rlike(RULE),
        under=lambda x: x["body"].rlike(UNDERLINE),
        mark=lambda x: F.when(x["body"].rlike(RULE), "").otherwise(F.regexp_extract(x["body"], MARKER, 0)),
    )
    had = ["rest", "depth", "body", "indent", "rule", "under", "mark"]
    out = _with(out, had, core=lambda x: x["body"].substr(F.length(x["mark"]) + 1, F.length(x["body"])))

    def start(x: Column) -> Column:
        found = F.lit(0)
        for kind in sorted(STARTS, reverse=True):
            found = F.when(x["core"].rlike(STARTS[kind]), kind).otherwise(found)
        return F.when(x["core"].startswith("<"), found).otherwise(0)

    def ends(x: Column) -> Column:
        bits = F.lit(0)
        for kind, pattern in ENDS.items():
            bits = bits + F.when(x["rest"].rlike(pattern), 1 << kind).otherwise(0)
        return F.when(x["rest"].contains(">"), bits).otherwise(0)

    out = F.transform(
        out,
        lambda x: F.struct(
            x["depth"].alias("depth"), x["indent"].alias("indent"), x["rule"].alias("rule"), x["under"].alias("under"),
            (x["body"] == "").alias("blank"), (x["core"] == "").alias("empty"), F.length(x["mark"]).alias("mark"),
            # an ordered list that does not start with 1 cannot interrupt a paragraph
            (x["mark"].rlike("^[0-9]") & ~x["mark"].rlike(r"^1[.)]")).alias("late"),
            x["core"].rlike(ATX).alias("atx"),
            F.length(F.concat(F.regexp_extract(x["core"], FENCE, 1), F.regexp_extract(x["core"], FENCE, 2))).alias("fence"),
            F.substring(x["core"], 1, 1).alias("char"), x["core"].rlike(BARE).alias("bare"),
            start(x).alias("html"), ends(x).alias("ends"),
        ),
    )
    return F.zip_with(out, _inline(lines), lambda x, n: F.struct(x.alias("l"), n.alias("inline")))


def _step(s: Column, row: Column) -> Column:
    line, inline = row["l"], row["inline"]
    within = (line["depth"] > s["quote"]) | ((line["depth"] == s["quote"]) & (line["blank"] | (line["indent"] >= s["column"])))
    ended = (s["html"] >= 6) & line["blank"] & (line["depth"] <= s["quote"])
    same = line["depth"] == s["quote"]
    none = F.array().cast("array<int>")
    items = F.when(same, s["items"]).otherwise(none)
    first = F.struct(
        ((s["fence"] > 0) & within).alias("in_fence"), ((s["html"] > 0) & within & ~ended).alias("in_html"),
        (s["para"] & same).alias("para"), items.alias("items"), F.filter(items, lambda c: c <= line["indent"]).alias("kept"),
    )

    def classed(a: Column) -> Column:
        rel = line["indent"] - F.coalesce(F.array_max(a["kept"]), F.lit(0))
        near = rel < 4
        marks = near & (line["mark"] > 0) & ~(a["para"] & (line["empty"] | line["late"]))
        html = near & (line["html"] > 0)
        starts = marks | (near & (line["mark"] == 0) & (line["atx"] | (line["fence"] > 0) | line["rule"] | (html & (line["html"] < 7))))
        lazy = (s["para"] & (line["depth"] < s["quote"])) | a["para"]
        flat = F.size(a["kept"]) == F.size(a["items"])
        kind = (
            F.when(a["in_fence"], IN_FENCE).when(a["in_html"], IN_HTML).when(line["blank"], BLANK)
            .when(a["para"] & line["under"] & near & flat, SETEXT).when(lazy & ~starts, MORE).when(~near, CODE)
            .when(line["rule"], HR).when(line["atx"], HEADING).when(line["fence"] > 0, OPENS_FENCE).when(html, OPENS_HTML).otherwise(TEXT)
        )
        return F.struct(kind.alias("kind"), marks.alias("marks"), flat.alias("flat"), a["items"].alias("items"), a["kept"].alias("kept"))

    def nested(c: Column) -> Column:
        new = F.when(c["marks"] & (c["kind"] > CODE), F.array(line["indent"] + line["mark"])).otherwise(none)
        open_ = F.when(c["kind"] >= CODE, F.concat(c["kept"], new)).when(c["kind"] == BLANK, c["items"]).otherwise(s["items"])
        return F.struct(c["kind"].alias("kind"), c["flat"].alias("flat"), open_.alias("items"))

    def after(c: Column) -> Column:
        kind = c["kind"]
        closes = same & line["bare"] & (line["mark"] == 0) & (line["char"] == s["char"]) & (line["fence"] >= s["fence"]) & (line["indent"] - s["column"] < 4)

        def left(html: Column) -> Column:
            return F.when((html < 6) & (line["ends"].bitwiseAND(_int(F.pow(F.lit(2), html))) != 0), 0).otherwise(html)

        def counted(name: str, when: Column, by: Column | int = 1) -> Column:
            return F.when(when, s[name] + by).otherwise(s[name]).alias(name)

        opens = kind.isin(OPENS_FENCE, OPENS_HTML)
        return F.struct(
            F.when(kind.isin(IN_FENCE, IN_HTML, MORE), s["quote"]).otherwise(line["depth"]).alias("quote"),
            c["items"].alias("items"),
            ((kind == MORE) | ((kind == TEXT) & ~line["empty"])).alias("para"),
            ((kind == CODE) | ((kind == BLANK) & s["code"] & same)).alias("code"),
            F.when(kind == OPENS_FENCE, line["char"]).otherwise(s["char"]).alias("char"),
            F.when(kind == OPENS_FENCE, line["fence"]).when((kind == IN_FENCE) & ~closes, s["fence"]).otherwise(0).alias("fence"),
            F.when(kind == OPENS_HTML, left(line["html"])).when(kind == IN_HTML, left(s["html"])).otherwise(0).alias("html"),
            F.when(opens, F.coalesce(F.array_max(c["items"]), F.lit(0))).when(kind < BLANK, s["column"]).otherwise(0).alias("column"),
            counted("fences", kind == OPENS_FENCE),
            counted("indented", (kind == CODE) & ~(s["code"] & same & c["flat"])),
            counted("quotes", (kind >= BLANK) & (line["depth"] > s["quote"]), line["depth"] - s["quote"]),
            counted("atx", kind == HEADING), counted("setext", kind == SETEXT), counted("rules", kind == HR),
            counted("html_lines", kind.isin(IN_HTML, OPENS_HTML)),
            counted("inline", kind.isin(MORE, HEADING, TEXT), inline),
        )

    return _let(_let(_let(first, classed), nested), after)


def block_counts(text: Column) -> Column:
    """A struct of ``COUNTS``, ``bullet`` and ``total`` for a text (null for null)."""
    zero = F.lit(0)
    state = F.struct(
        zero.alias("quote"), F.array().cast("array<int>").alias("items"), F.lit(False).alias("para"), F.lit(False).alias("code"),
        F.lit("").alias("char"), zero.alias("fence"), zero.alias("html"), zero.alias("column"), *[zero.alias(c) for c in COUNTS],
    )

    def done(s: Column) -> Column:
        bullet = F.regexp_count(text, F.lit(md.BULLET))
        total = bullet
        for c in COUNTS:
            total = total + s[c]
        return F.struct(*[s[c].cast("long").alias(c) for c in COUNTS], bullet.cast("long").alias("bullet"), total.cast("long").alias("total"))

    return F.when(text.isNotNull(), F.aggregate(_lines(text), state, _step, done))
