"""A plain line-by-line reading of the block rules, without patterns, to set
beside the native fold. Inline events: tags and comments within a line only."""

TAGS = {"div", "p", "table", "h1"}
RAW = ("script", "pre", "style", "textarea")


def _tag_end(s: str) -> int:
    """Length of the simple tag at the start of ``s``, 0 if there is none."""
    end = s.find(">")
    name = s[1:end].strip("/") if end > 0 else ""
    return end + 1 if s.startswith("<") and name.isalnum() and name[:1].isalpha() else 0


def _inline(line: str) -> int:
    n = i = 0
    while i < len(line):
        if line.startswith("<!--", i) and "-->" in line[i + 4 :]:
            n, i = n + 1, line.index("-->", i + 4) + 3
        elif _tag_end(line[i:]):
            n, i = n + 1, i + _tag_end(line[i:])
        else:
            i += 1
    return n


def _html(core: str) -> int:
    low = core.lower()
    for name in RAW:
        rest = low[1 + len(name) :]
        if low.startswith("<" + name) and (not rest or rest[0] in " >"):
            return 1
    if low.startswith("<!--"):
        return 2
    if low.startswith("<"):
        name = low[1:].removeprefix("/")
        word = name[: next((i for i, c in enumerate(name) if not c.isalnum()), len(name))]
        after = name[len(word) :]
        if word in TAGS and (after[:1] in ("", " ", ">") or after[:2] == "/>"):
            return 6
        if _tag_end(low) and not low[_tag_end(low) :].strip(" "):
            return 7
    return 0


def _ended(kind: int, line: str) -> bool:
    if kind == 1:
        return any(f"</{n}>" in line.lower() for n in RAW)
    return kind == 2 and "-->" in line


def _marker(body: str) -> int:
    sign = 1 if body[:1] in ("-", "+", "*") else 0
    if not sign:
        digits = len(body) - len(body.lstrip("0123456789"))
        sign = digits + 1 if 1 <= digits <= 9 and body[digits : digits + 1] in (".", ")") else 0
    rest = body[sign:]
    if not sign or (rest and rest[0] != " "):
        return 0
    return sign + len(rest) - len(rest.lstrip(" "))


def scan(text: str) -> dict[str, int]:
    n = dict.fromkeys(("fences", "indented", "quotes", "atx", "setext", "rules", "html_lines", "inline"), 0)
    quote, items, para, code, fence, html = 0, [], False, False, None, None
    for line in text.replace("\t", "    ").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        rest, depth = line, 0
        while (len(rest) - len(rest.lstrip(" "))) < 4 and rest.lstrip(" ")[:1] == ">":
            rest, depth = rest.lstrip(" ")[1:].removeprefix(" "), depth + 1
        body = rest.lstrip(" ")
        indent, blank = len(rest) - len(body), body == ""
        block = fence or html
        if block and (depth > quote or (depth == quote and (blank or indent >= block["column"]))):
            if fence:
                bare = body.rstrip(" ")
                closing = depth == quote and bare and set(bare) == {fence["char"]} and len(bare) >= fence["len"]
                if closing and indent - fence["column"] < 4:
                    fence = None
                continue
            if not (html["kind"] >= 6 and blank and depth <= quote):
                n["html_lines"] += 1
                if _ended(html["kind"], rest):
                    html = None
                continue
        fence = html = None
        same = depth == quote
        held = items if same else []
        if blank:
            n["quotes"] += max(0, depth - quote)
            code, para, quote, items = code and same, False, depth, held
            continue
        kept = [c for c in held if c <= indent]
        rel = indent - (kept[-1] if kept else 0)
        squeezed = body.replace(" ", "")
        rule = len(squeezed) >= 3 and set(squeezed) in ({"*"}, {"-"}, {"_"})
        mark = 0 if rule else _marker(body)
        core = body[mark:]
        here = para and same
        late = body[0].isdigit() and body[:2] not in ("1.", "1)")
        marks = rel < 4 and mark > 0 and not (here and (core == "" or late))
        hashes = len(core) - len(core.lstrip("#"))
        atx = 1 <= hashes <= 6 and core[hashes : hashes + 1] in ("", " ")
        ticks = max(len(core) - len(core.lstrip("`")), len(core) - len(core.lstrip("~")))
        opens = ticks >= 3 and not (core[0] == "`" and "`" in core[ticks:])
        kind = _html(core) if rel < 4 else 0
        starts = marks or (rel < 4 and not mark and (atx or opens or rule or 0 < kind < 7))
        under = body.rstrip(" ")
        if here and rel < 4 and len(kept) == len(held) and set(under) in ({"="}, {"-"}):
            n["setext"] += 1
            para = False
            continue
        if para and depth <= quote and not starts:
            n["inline"] += _inline(line)
            code = False
            continue
        n["quotes"] += max(0, depth - quote)
        quote, para = depth, False
        if rel >= 4:
            n["indented"] += not (code and same and len(kept) == len(held))
            code, items = True, kept
            continue
        code, items = False, kept + ([indent + mark] if marks else [])
        column = items[-1] if items else 0
        if rule:
            n["rules"] += 1
        elif atx:
            n["atx"] += 1
            n["inline"] += _inline(line)
        elif opens:
            n["fences"] += 1
            fence = {"char": core[0], "len": ticks, "column": column}
        elif kind:
            n["html_lines"] += 1
            html = None if _ended(kind, rest) else {"kind": kind, "column": column}
        else:
            n["inline"] += _inline(line)
            para = core != ""
    return n
