"""Mutation check: break one rule at a time in the declared metric steps and
"""

import pytest
from pyspark.sql import functions as F

from penmark.functions import markdown as md
from penmark.functions import spec as S
from penmark.functions.metrics import METRICS, metric_steps
from penmark.functions.phrases import family_pattern
from test_golden import CASES, MARKDOWN


def _rewrite(e, fn):
    """Apply ``fn`` bottom-up to every node of an expression tree."""
    if isinstance(e, S.E):
        args = tuple(_rewrite(a, fn) for a in e.args)
        return fn(S.E(e.op, args))
    return e


def _mutated_steps(fn):
    return [[(n, _rewrite(e, fn)) for n, e in level] for level in metric_steps("text")]


def _lower_for_translate(e):
    if e.op == "translate":
        return S.native(lambda c: F.lower(c), lambda c: f"lower({c})", e.args[0])
    return e


def _ascii_trim(e):
    return S.E("trim", (e.args[0], " ")) if e.op == "trim" else e


def _no_blank_collapse(e):
    return e.args[0] if e.op == "replace" and e.args[1] == "\n\n" else e


def _no_negative(e):
    return e.args[0] if e.op == "sub" else e


def _any_hyphen(e):
    if e.op == "count" and "-\\p{M}" in e.args[1].replace("[", ""):
        return S.count(e.args[0], e.args[1].split("|-")[0] + "|-[^ ]")
    return e


def _no_perspective_spaces(e):
    if e.op == "count" and e.args[1] == family_pattern("perspective"):
        return S.count(e.args[0], "we|us|our|them|people")
    return e


def _naive_strong(e):
    if e.op == "count" and e.args[1] == md.STRONG:
        return S.count(e.args[0], r"\*\*[^*]+\*\*")
    return e


def _labels_any_line(e):
    if e.op == "count" and ":" in e.args[1] and "IsAlphabetic" in e.args[1]:
        return S.count(e.args[0], "(?:^|\\n)[^:\\n]*:")
    return e


MUTATIONS = {
    "lower instead of ASCII-only lower-case": _lower_for_translate,
    "ASCII trim instead of Unicode trim": _ascii_trim,
    "no blank-line collapse": _no_blank_collapse,
    "negative phrases not subtracted": _no_negative,
    "any hyphen before a non-space counts": _any_hyphen,
    "pronouns without their spaces": _no_perspective_spaces,
    "naive strong emphasis": _naive_strong,
    "any text before a colon is a label": _labels_any_line,
}


def _run(spark, steps, texts):
    from penmark.functions.emoji import emoji_table
    from penmark.functions.metrics import helper_columns

    emoji_table(spark)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = S.apply_steps(df, steps).drop(*[c for c in helper_columns() if c != "_t1"])
    return {r.doc_id: r for r in out.collect()}


@pytest.fixture(scope="module")
def baseline(spark):
    texts = [t for t, _ in CASES] + [t for t, _ in MARKDOWN] + ["　 HI À \n\n"]
    return texts, _run(spark, metric_steps("text"), texts)


@pytest.mark.parametrize("name", list(MUTATIONS))
def test_mutation_is_caught(spark, baseline, name):
    texts, good = baseline
    bad = _run(spark, _mutated_steps(MUTATIONS[name]), texts)
    cols = METRICS + ["sentence_count", "_t1"]
    changed = [i for i in good if any(good[i][c] != bad[i][c] for c in cols)]
    assert changed, f"mutation '{name}' changed no golden output"
