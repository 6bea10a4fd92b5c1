"""Secret scans over a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived (an OR of
ANDs): what every match must contain. The index posts, for each trigram that
some query asks for, the rows that contain it, over whole texts with A-Z
folded to a-z. A rule's candidates are the rows whose postings hold all
trigrams of one of its clauses; only those are verified with the rule's regex.
A rule without a mandatory trigram is run on every row. All text is scanned;
folding and trigrams only ever admit too many rows, so no match is lost.

Rows are keyed by id and text hash. The candidates are broadcast when their
number is checked to be at most ``BROADCAST_ROWS``, else joined by a shuffle.

Defined cases: a null text is empty and holds nothing; rows that repeat an id
and a text have the same result each; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written

BROADCAST_ROWS = 2_000_000
EXACT = 48  # strings that a part of a regex may stand for, before its trigrams are taken


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the part whose length counts
    least: int = 0
    any_case: bool = False
    base: bool = False

    @property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# FIXED VALUES: the base rules, in the order in which ties are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, False, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, False, True),
)
# Further rules; they add spans.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("vcs_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("web_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("url_login", r"://[A-Za-z0-9._%+-]++:[^\s/@:]++@[A-Za-z0-9.-]+"),
)
RULES = BASE + MORE


# -- the query of a regex ------------------------------------------------------
# A part is known either by the finite set of strings it stands for, or by its
# clauses: a set of trigram sets, one of which every match contains.

Clauses = frozenset[frozenset[str]]
ANY: Clauses = frozenset([frozenset()])


def _least(clauses: Clauses) -> Clauses:
    """Drop clauses that another one is part of."""
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def _and(a: Clauses, b: Clauses) -> Clauses:
    both = _least(frozenset(x | y for x, y in product(a, b)))
    return both if len(both) <= EXACT else a if b == ANY or len(a) <= len(b) else b


def _trigrams(strings: frozenset[str]) -> Clauses:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _walk(parsed) -> tuple[frozenset[str] | None, Clauses]:
    """(strings or None, clauses) of a sequence of parsed parts."""
    run: frozenset[str] | None = frozenset([""])
    clauses, exact = ANY, True
    for op, arg in parsed:
        strings, own = _part(op, arg)
        if strings is not None and run is not None and len(run) * len(strings) <= EXACT:
            run = frozenset(a + b for a in run for b in strings)
            continue
        clauses, exact = _and(_and(clauses, _trigrams(run)), own), False
        run = strings if strings is not None else frozenset([""])
    return (run, _trigrams(run)) if exact else (None, _and(clauses, _trigrams(run)))


def _part(op, arg) -> tuple[frozenset[str] | None, Clauses]:
    if op is sre.LITERAL:
        return frozenset([_fold(chr(arg))]), ANY
    if op is sre.IN:
        chars: set[str] = set()
        for kind, what in arg:
            if kind is sre.LITERAL:
                chars.add(_fold(chr(what)))
            elif kind is sre.RANGE and what[1] - what[0] < EXACT:
                chars |= {_fold(chr(c)) for c in range(what[0], what[1] + 1)}
            else:
                return None, ANY
        return (frozenset(chars), ANY) if len(chars) <= 8 else (None, ANY)
    if op is sre.SUBPATTERN:
        return _walk(arg[-1])
    if op is sre.BRANCH:
        parts = [_walk(b) for b in arg[1]]
        if all(s is not None for s, _ in parts):
            return frozenset().union(*(s for s, _ in parts)), ANY
        return None, _least(frozenset().union(*(_trigrams(s) if s is not None else c for s, c in parts)))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, what = arg
        strings, own = _walk(what)
        if strings is not None and high == 1:
            return strings | (frozenset([""]) if low == 0 else frozenset()), ANY
        if low == 0:
            return None, ANY
        return None, _trigrams(strings) if strings is not None else own
    if op is sre.AT:
        return frozenset([""]), ANY
    return None, ANY  # any other part may stand for anything


def _fold(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses one of which every match meets; None: no mandatory trigram."""
    strings, clauses = _walk(_parser.parse(pattern))
    clauses = _trigrams(strings) if strings is not None else clauses
    return None if frozenset() in clauses else sorted(clauses, key=sorted)


# -- the index -----------------------------------------------------------------

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _codes(trigrams: set[str]) -> np.ndarray:
    """Byte trigrams (UTF-8) as 24-bit numbers."""
    found = set()
    for t in trigrams:
        b = t.encode()
        found |= {(b[i] << 16) | (b[i + 1] << 8) | b[i + 2] for i in range(len(b) - 2)}
    return np.array(sorted(found), np.int32)


def build_index(rows: DataFrame, trigrams: set[str]) -> DataFrame:
    """Postings (``code``, ``key_id``, ``key_hash``) of the asked trigrams,
    written to the shared folder. ``rows``: key_id, key_hash, text."""
    ship(rows.sparkSession)
    asked = _codes(trigrams)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << 24, bool)
        wanted[asked] = True
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                some = batch.slice(first, 1024)
                codes, at = [], []
                for i, text in enumerate(some.column("text")):
                    b = np.frombuffer((text.as_py() or "").encode().translate(_LOWER), np.uint8).astype(np.int32)
                    if len(b) >= 3:
                        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
                        has = np.unique(code[wanted[code]])
                        codes.append(has)
                        at.append(np.full(len(has), i))
                if codes:
                    where = pa.array(np.concatenate(at), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(codes), pa.int32()), some.column("key_id").take(where), some.column("key_hash").take(where)],
                        names=["code", "key_id", "key_hash"],
                    )

    return written(rows.mapInArrow(post, "code int, key_id long, key_hash long"), "trigram-index")


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """Rows (key_id, key_hash) with the list of ``rules`` whose query their
    postings satisfy. The clause table has one row per trigram of a clause:
    its size depends on the rules alone."""
    needs, clause = [], 0
    for rule, clauses in queries.items():
        for trigrams in clauses:
            codes = _codes(set(trigrams))
            needs += [(clause, rule, int(c), len(codes)) for c in codes]
            clause += 1
    asked = index.sparkSession.createDataFrame(needs or [], "clause int, rule int, code int, needed int")
    met = index.join(F.broadcast(asked), "code").distinct()
    met = met.groupBy("clause", "rule", "needed", "key_id", "key_hash").count().where("count = needed")
    return met.groupBy("key_id", "key_hash").agg(F.collect_set("rule").alias("rules"))


# -- verification --------------------------------------------------------------

_HEX = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _matches(rule: Rule, regex: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in regex.finditer(text) if len(m[rule.group]) >= rule.least]


def find(text: str, rules: list[int], compiled: list[re.Pattern], full: re.Pattern | None = None) -> list[tuple[int, int, int]]:
    """(start, rule, end) of all matches of the given rules, sorted."""
    out = []
    for k in rules:
        rule, regex = RULES[k], compiled[k]
        if rule.kind == "hex":  # a run of the class is a match: those long enough, and only if there is one
            if b"h" * rule.least not in text.encode().translate(_HEX):
                continue
            regex = full or regex
        out += [(a, k, b) for a, b in _matches(rule, regex, text)]
    return sorted(out)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, the digest of
    the base spans, and all spans ``kind:start:end`` in code points."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").alias("key_id"), F.xxhash64("text").alias("key_hash"), "text")
    queries = {k: trigram_query(r.pattern) for k, r in enumerate(RULES)}
    always = [k for k, q in queries.items() if q is None]
    asked = {k: q for k, q in queries.items() if q is not None}
    index = build_index(rows, {t for q in asked.values() for c in q for t in c})
    chosen = written(candidates(index, asked), "secret-candidates")
    chosen = chosen.select(F.col("key_id").alias("c_id"), F.col("key_hash").alias("c_hash"), "rules")
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    rows = rows.join(chosen, F.col("key_id").eqNullSafe(F.col("c_id")) & (F.col("key_hash") == F.col("c_hash")), "left")
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{r.kind}", pa.int64()) for r in BASE], ("base_sha256", pa.string()), ("spans", pa.string())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [r.regex for r in RULES]
        long_run = re.compile(r"[0-9a-f]{%d,}" % RULES[2].least)
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                some, out = batch.slice(first, 1024), []
                for doc, text, rules in zip(*(some.column(c) for c in ("key_id", "text", "rules"))):
                    got = find(text.as_py() or "", sorted({*always, *(rules.as_py() or [])}), compiled, long_run)
                    said = [f"{RULES[k].kind}:{a}:{b}" for a, k, b in got]
                    base = [s for s, (_, k, _) in zip(said, got) if RULES[k].base]
                    counts = [sum(k == j for _, k, _ in got) for j in range(len(BASE))]
                    out.append((doc.as_py(), *counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(said)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.select("key_id", "text", "rules").mapInArrow(verify, RESULT)
