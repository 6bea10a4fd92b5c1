"""Main text of web pages: streaming parser events, text-to-tag ratios per
line, Gaussian smoothing and threshold clustering.

The standard library's parser walks the page once and hands out lines: the
text between two block boundaries (block tags, their ends, line breaks) with
the number of tags met in it, its words, the words inside links, and what
encloses it. A line inside a part that is never content (navigation, header or
footer of the page, aside, form, script, style, adverts, notices, comments of
readers, recognised by tag, or on containers by role, class or id) has ratio 0.
A name says nothing after "has", "no" or "with", nor on an element that holds
most of the page's text; a name that an article's section may have as well
(related, search, share) counts only where the element's own text-to-tag ratio
is low.

The ratio of a line is its words outside links over its tags (at least 1).
Ratios are smoothed along the page with a Gaussian of ``SIGMA`` lines. Lines
whose smoothed ratio is above the threshold (a share of the page's deviation)
are content seeds; neighbouring seeds cluster to regions, and the element
that encloses all regions (the article, else the main part, else the innermost
element) gives the text: its lines outside the parts that are never content. So a short heading or closing sentence of the article
stays, and a long sentence in a footer does not enter.

Defined cases: a null or empty page has an empty text; a page without words
has an empty text; unclosed and stray tags close as the parser meets their
parents' ends; very long pages are walked once, in memory in proportion to
their length; repeated rows give the same text; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

SIGMA = 1.0
SHARE = 0.5  # of the standard deviation of the ratios
SPACE = re.compile(r"\s+")

BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never content, with all that they enclose.
OFF = frozenset(
    "applet aside audio button canvas dialog embed footer form head iframe input map math menu nav noframes noscript object option "
    "script select style svg template textarea title video".split()
)
#: Elements whose end also ends what is open inside, and what they close when they begin.
CLOSERS = {
    "p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"),
    "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",),
}
BOUNDS = frozenset("article aside body div dl footer form header html main nav ol section table td th ul".split())
#: Words of a class, id or role that mark a part as no content.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline cookie cookies consent "
    "comment comments commentlist complementary contentinfo copyright disqus feedback footer gdpr menu menubar nav navbar "
    "navigation newsletter notice notices notification pager pagination popup promo promos promoted promotion related reply replies "
    "respond search sharing share sidebar sidebars signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Marks that a section of an article may have too: they need a low ratio.
UNSURE = frozenset("byline menu menubar related reply replies respond search share sharing social".split())
LOW = 0.5  # of the page's ratio
#: Tags that the marks switch off; headings, paragraphs and inline tags never are.
MARKED = frozenset("center dd details div dl dt fieldset figure hgroup li ol section table tbody td tfoot th thead tr ul".split())
#: Words after which a name tells of another part.
ABOUT = frozenset("has have no not with without".split())
#: Parts that the marks don't switch off: they hold the page, not a part of it.
WHOLE = frozenset("html body main article".split())
NAMES = re.compile(r"[A-Za-z]+")


def _is_off(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    if tag in OFF:
        return True
    if tag == "header":
        return not inside  # an article's own header holds its heading
    named = dict(attrs)
    if "hidden" in named or (named.get("aria-hidden") or "").lower() == "true":
        return tag not in WHOLE
    if "display:none" in (named.get("style") or "").replace(" ", "").lower():
        return tag not in WHOLE
    return False


def _mark(tag: str, attrs: list[tuple[str, str | None]]) -> str | None:
    """"sure", "unsure" or None: what the names of an element say of it."""
    if tag not in MARKED:
        return None
    named, found = dict(attrs), None
    for name in " ".join(named.get(k) or "" for k in ("class", "id", "role")).split():
        for word in NAMES.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name)):
            if word.lower() in ABOUT:
                break
            if word.lower() in UNSURE:
                found = "unsure"
            elif word.lower() in MARKS:
                return "sure"
    return found


class Lines(HTMLParser):
    """Collects lines: (text, tags, words, linked words, path of open elements, off),
    and for each line the marked elements around it: (number, mark)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, tuple, bool]] = []
        self.marked: list[tuple] = []
        self.open: list[tuple[str, int, bool, bool]] = []  # name, number, off, marked
        self.path: tuple = ()
        self.marks: tuple = ()
        self.number = 0
        self.off = 0
        self.links = 0
        self.inside = 0
        self.text: list[str] = []
        self.tags = 0
        self.linked = 0

    def _end_line(self) -> None:
        if self.text:
            text = SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                self.lines.append((text, self.tags, text.count(" ") + 1, self.linked, self.path, self.off > 0))
                self.marked.append(self.marks)
            self.text = []
        self.tags = self.linked = 0

    def _push(self, tag: str, off: bool, mark: str | None) -> None:
        self.number += 1
        self.open.append((tag, self.number, off, mark is not None))
        if mark:
            self.marks = (*self.marks, (self.number, mark))
        self.off += off
        self.links += tag == "a"
        self.inside += tag in ("article", "main")
        if tag in BOUNDS:
            self.path = (*self.path, (tag, self.number))

    def _pop(self) -> None:
        tag, number, off, marked = self.open.pop()
        if marked:
            self.marks = self.marks[:-1]
        self.off -= off
        self.links -= tag == "a"
        self.inside -= tag in ("article", "main")
        if tag in BOUNDS:
            self.path = self.path[:-1]

    def _close(self, tags: tuple[str, ...], stops: frozenset[str]) -> None:
        """Close the innermost of ``tags``, unless one of ``stops`` lies between."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                while len(self.open) > k:
                    self._pop()
                return
            if self.open[k][0] in stops:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        if tag in CLOSERS:
            self._close(CLOSERS[tag], BOUNDS)
        elif tag in BOUNDS:
            self._close(("p",), BOUNDS)
        if tag not in VOID:
            self._push(tag, _is_off(tag, attrs, self.inside > 0), _mark(tag, attrs))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML knows no empty elements but the void ones

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        if tag not in VOID:
            self._close((tag,), frozenset() if tag in BOUNDS else BOUNDS)

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.links:
            self.linked += len(data.split())

    def finish(self) -> list[tuple[str, int, int, int, tuple, bool]]:
        if re.match(r"<[A-Za-z/!?]", self.rawdata):
            self.rawdata = ""  # a tag or comment that the page's end cuts off
        self.close()
        self._end_line()
        return judged(self.lines, self.marked)


def judged(lines: list[tuple[str, int, int, int, tuple, bool]], marked: list[tuple]) -> list[tuple[str, int, int, int, tuple, bool]]:
    """The lines, off as well where a marked element's own text doesn't speak against the mark."""
    own: dict[tuple[int, str], list[int]] = {}  # free words, tags, linked words
    page = [0, 0, 0]
    for (_, tags, words, linked, _, off), marks in zip(lines, marked):
        if not off:
            linked = min(linked, words)
            for sums in (page, *(own.setdefault(m, [0, 0, 0]) for m in marks)):
                sums[0] += words - linked
                sums[1] += tags
                sums[2] += linked
    drop = set()
    for mark, (free, tags, linked) in own.items():
        low = free <= linked or free * max(1, page[1]) < LOW * page[0] * max(1, tags)
        if 2 * free <= page[0] and (mark[1] == "sure" or low):
            drop.add(mark)
    return [(*line[:5], line[5] or not drop.isdisjoint(marks)) for line, marks in zip(lines, marked)]


def smooth(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    whole = sum(kernel)
    n = len(ratios)
    return [sum(k * ratios[i + d] for d, k in zip(range(-reach, reach + 1), kernel) if 0 <= i + d < n) / whole for i in range(n)]


def regions(lines: list[tuple[str, int, int, int, tuple, bool]]) -> list[tuple[int, int]]:
    """Clusters of content lines, [first, after)."""
    ratios = [0.0 if off else (words - min(linked, words)) / max(1, tags) for _, tags, words, linked, _, off in lines]
    even = smooth(ratios)
    mean = sum(even) / len(even)
    least = min(SHARE * math.sqrt(sum((x - mean) ** 2 for x in even) / len(even)), mean)
    found: list[tuple[int, int]] = []
    for i, x in enumerate(even):
        if x >= least and ratios[i] > 0:
            if found and found[-1][1] == i:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((i, i + 1))
    return found


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    lines = parser.finish()
    if not any(words > linked and not off for _, _, words, linked, _, off in lines):
        return "\n".join(line[0] for line in lines if not line[5])
    # the elements around all regions: what the first and the last path in order share
    paths = [line[4] for first, after in regions(lines) for line in lines[first:after] if not line[5]]
    around = [a for a, b in zip(min(paths), max(paths)) if a == b] if paths else []
    within = next((e for name in ("article", "main") for e in around if e[0] == name), None)
    if within is None:
        within = next((e for e in reversed(around) if e[0] not in ("td", "th")), None)
    return "\n".join(line[0] for line in lines if not line[5] and (within is None or within in line[4]))


RESULT = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    ship(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                some = batch.slice(first, 512)
                texts = [main_text(x.as_py()) for x in some.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, RESULT)
