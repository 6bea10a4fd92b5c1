"""One declaration, two renderings.

The text-metric pipeline is declared once as ordered steps of small column
expressions. :func:`to_column` renders a step as a PySpark ``Column``
(executed by Catalyst/Tungsten); :func:`to_sql` renders the same step as
DuckDB SQL for the correctness twins. Sharing the declaration keeps the
regex strings identical on both sides. This is only a way to write column
expressions once; nothing here plans or executes anything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class E:
    op: str
    args: tuple

    # small operator sugar for readability
    def __add__(self, other: "E") -> "E":
        return E("add", (self, other))


def col(name: str) -> E:
    return E("col", (name,))


def lit(value) -> E:
    return E("lit", (value,))


def count(e: E, java: str, re2: str | None = None) -> E:
    return E("count", (e, java, re2 if re2 is not None else java))


def rreplace(e: E, pattern: str, repl: str) -> E:
    return E("rreplace", (e, pattern, repl))


def replace(e: E, old: str, new: str) -> E:
    return E("replace", (e, old, new))


def translate(e: E, src: str, dst: str) -> E:
    return E("translate", (e, src, dst))


def trim(e: E, chars: str) -> E:
    return E("trim", (e, chars))


def concat(*es: E) -> E:
    return E("concat", es)


def contains(e: E, s: str) -> E:
    return E("contains", (e, s))


def rlike(e: E, java: str, re2: str | None = None) -> E:
    return E("rlike", (e, java, re2 if re2 is not None else java))


def any_of(*es: E) -> E:
    return E("or", es)


def when(cond: E, then: E, otherwise: E) -> E:
    return E("when", (cond, then, otherwise))


def zero_or_null(e: E) -> E:
    """0, or null when ``e`` is null (the skipped branch of a gated count)."""
    return E("zero_or_null", (e,))


def greatest(*es: E) -> E:
    return E("greatest", es)


def add(*es: E) -> E:
    return E("add", es)


def sub(a: E, b: E) -> E:
    return E("sub", (a, b))


def mul(a: E, k) -> E:
    return E("mul", (a, k))


def div(a: E, b: E) -> E:
    return E("div", (a, b))


def as_double(e: E) -> E:
    return E("double", (e,))


def native(spark_fn, sql_fn, *es: E) -> E:
    """An expression given directly as a Spark builder and a SQL builder."""
    return E("native", (spark_fn, sql_fn) + es)


def quick(cond: E, then: E, otherwise: E) -> E:
    """``then``, which Spark computes only where a cheap necessary condition
    holds; elsewhere ``otherwise`` is the same value. The twin has ``then`` alone."""
    return E("quick", (cond, then, otherwise))


def spark_only(spark_fn, *es: E) -> E:
    """A helper column of the Spark side; the twin's steps leave it out."""
    return E("spark_only", (spark_fn,) + es)


# ------------------------------------------------------------------ Spark side
def to_column(e: E) -> Column:
    op, a = e.op, e.args
    if op == "col":
        return F.col(a[0])
    if op == "lit":
        return F.lit(a[0])
    if op == "count":
        return F.regexp_count(to_column(a[0]), F.lit(a[1]))
    if op == "rreplace":
        return F.regexp_replace(to_column(a[0]), F.lit(a[1]), F.lit(a[2]))
    if op == "replace":
        return F.replace(to_column(a[0]), F.lit(a[1]), F.lit(a[2]))
    if op == "translate":
        return F.translate(to_column(a[0]), a[1], a[2])
    if op == "trim":
        return F.trim(to_column(a[0]), F.lit(a[1]))
    if op == "concat":
        return F.concat(*[to_column(x) for x in a])
    if op == "contains":
        return to_column(a[0]).contains(a[1])
    if op == "rlike":
        return to_column(a[0]).rlike(a[1])
    if op == "or":
        out = to_column(a[0])
        for x in a[1:]:
            out = out | to_column(x)
        return out
    if op in ("when", "quick"):
        return F.when(to_column(a[0]), to_column(a[1])).otherwise(to_column(a[2]))
    if op == "greatest":
        return F.greatest(*[to_column(x) for x in a])
    if op == "zero_or_null":
        return F.when(to_column(a[0]).isNull(), F.lit(None).cast("int")).otherwise(F.lit(0))
    if op == "add":
        out = to_column(a[0])
        for x in a[1:]:
            out = out + to_column(x)
        return out
    if op == "sub":
        return to_column(a[0]) - to_column(a[1])
    if op == "mul":
        return to_column(a[0]) * F.lit(a[1])
    if op == "div":
        return to_column(a[0]) / to_column(a[1])
    if op == "double":
        return to_column(a[0]).cast("double")
    if op == "native":
        return a[0](*[to_column(x) for x in a[2:]])
    if op == "spark_only":
        return a[0](*[to_column(x) for x in a[1:]])
    raise ValueError(op)


# -------------------------------------------------------------------- SQL side
def sql_str(text: str) -> str:
    """A DuckDB string literal; control characters go through chr()."""
    parts: list[str] = []
    buf: list[str] = []
    for ch in text:
        cp = ord(ch)
        if cp < 0x20 or 0x7F <= cp <= 0x9F:
            if buf:
                parts.append("'" + "".join(buf).replace("'", "''") + "'")
                buf = []
            parts.append(f"chr({cp})")
        else:
            buf.append(ch)
    if buf or not parts:
        parts.append("'" + "".join(buf).replace("'", "''") + "'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def to_sql(e: E) -> str:
    op, a = e.op, e.args
    if op == "col":
        return a[0]
    if op == "lit":
        v = a[0]
        return sql_str(v) if isinstance(v, str) else repr(v)
    if op == "count":
        return f"len(regexp_extract_all({to_sql(a[0])}, {sql_str(a[2])}))"
    if op == "rreplace":
        return f"regexp_replace({to_sql(a[0])}, {sql_str(a[1])}, {sql_str(a[2])}, 'g')"
    if op == "replace":
        return f"replace({to_sql(a[0])}, {sql_str(a[1])}, {sql_str(a[2])})"
    if op == "translate":
        return f"translate({to_sql(a[0])}, {sql_str(a[1])}, {sql_str(a[2])})"
    if op == "trim":
        return f"trim({to_sql(a[0])}, {sql_str(a[1])})"
    if op == "concat":
        return "(" + " || ".join(to_sql(x) for x in a) + ")"
    if op == "contains":
        return f"(strpos({to_sql(a[0])}, {sql_str(a[1])}) > 0)"
    if op == "rlike":
        return f"regexp_matches({to_sql(a[0])}, {sql_str(a[2])})"
    if op == "or":
        return "(" + " OR ".join(to_sql(x) for x in a) + ")"
    if op == "when":
        return f"(CASE WHEN {to_sql(a[0])} THEN {to_sql(a[1])} ELSE {to_sql(a[2])} END)"
    if op == "quick":
        return to_sql(a[1])
    if op == "greatest":
        return "greatest(" + ", ".join(to_sql(x) for x in a) + ")"
    if op == "zero_or_null":
        return f"(CASE WHEN {to_sql(a[0])} IS NULL THEN NULL ELSE 0 END)"
    if op == "add":
        return "(" + " + ".join(to_sql(x) for x in a) + ")"
    if op == "sub":
        return f"({to_sql(a[0])} - {to_sql(a[1])})"
    if op == "mul":
        return f"({to_sql(a[0])} * {a[1]!r})"
    if op == "div":
        return f"({to_sql(a[0])} / {to_sql(a[1])})"
    if op == "double":
        return f"CAST({to_sql(a[0])} AS DOUBLE)"
    if op == "native":
        return a[1](*[to_sql(x) for x in a[2:]])
    raise ValueError(op)


Steps = list[list[tuple[str, E]]]


def apply_steps(df, steps: Steps):
    """Add each level of named columns in turn (one Project per level)."""
    for level in steps:
        df = df.withColumns({name: to_column(expr) for name, expr in level})
    return df


def sql_steps(source: str, steps: Steps, final_select: str, cte_prefix: str = "s") -> str:
    """The same levels as a chain of DuckDB CTEs over ``source``."""
    steps = [[(name, expr) for name, expr in level if expr.op != "spark_only"] for level in steps]
    steps = [level for level in steps if level]
    ctes = [f"{cte_prefix}0 AS (SELECT * FROM {source})"]
    for i, level in enumerate(steps, start=1):
        cols = ", ".join(f"{to_sql(expr)} AS {name}" for name, expr in level)
        ctes.append(f"{cte_prefix}{i} AS (SELECT *, {cols} FROM {cte_prefix}{i - 1})")
    last = f"{cte_prefix}{len(steps)}"
    return "WITH " + ",\n".join(ctes) + f"\n{final_select.format(src=last)}"
