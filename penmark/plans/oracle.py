"""DuckDB twins of the registered queries (tables are pre-registered views).

Built from the same declarations as the Spark side (pattern strings, step
lists, marker dict, weights), so the two engines read one specification.
"""

from __future__ import annotations

from ..functions import lexicon
from ..functions import markdown as md
from ..functions import spec as S
from ..functions.metrics import METRICS, metric_steps, normalize_steps
from ..functions.normalize import NON_BLANK, SENTENCE_SPLIT, WORD_SPLIT
from ..functions.phrases import family_pattern
from .blocks_sql import events_sql
from .marked import marked_sql
from .queries import FAMILY_ORDER, LLOYD_ROUNDS, MD_PARTS, OWN_LEXICONS, OWN_WEIGHTS, R, REPORT_DATE

FEATS = lexicon.FEATURE_NAMES
K = len(FEATS)
q = S.sql_str

MARKED = f"({marked_sql(('doc_id', 'lang', 'source', 'text'))}) AS mk"


def _norm() -> str:
    return S.sql_steps(MARKED, normalize_steps("text"), "SELECT * FROM {src}", "n")


def _metrics(source: str = MARKED, text: str = "text", keep=("doc_id", "lang", "source"), lexicons=None) -> str:
    cols = ", ".join(list(keep) + METRICS + ["sentence_count"])
    return S.sql_steps(source, metric_steps(text, lexicons=lexicons), f"SELECT {cols} FROM {{src}}", "m")


def _round(x: str) -> str:
    return f"round({x}, {R})"


def _metrics_out(key: str) -> str:
    return ", ".join([key] + [f"{_round(m)} AS {m}" for m in METRICS] + ["CAST(sentence_count AS BIGINT) AS sentence_count"])


def _feats_cte(source: str = MARKED, keep=("doc_id", "lang", "source"), weights=None, lexicons=None) -> str:
    named = [(m, (weights or {}).get(m, w)) for m, w in lexicon.FEATURE_WEIGHTS]
    fs = ", ".join(f"{m} * {float(w)!r} AS f{i}" for i, (m, w) in enumerate(named))
    cols = ", ".join(keep)
    return f"mt AS ({_metrics(source, 'text', keep, lexicons)}),\nfeats AS (SELECT {cols}, emoji_rate, {fs} FROM mt)"


def _dist(prefix: str) -> str:
    return "greatest(" + ", ".join(f"abs(f.f{i} - c.{prefix}{i})" for i in range(K)) + ")"


def _lloyd_ctes(rounds: int = LLOYD_ROUNDS) -> str:
    """feats, c0 (min/max start), rounds of assign/update, final assignment lf."""
    mins = ", ".join(f"min(f{i}) AS a{i}" for i in range(K))
    maxs = ", ".join(f"max(f{i}) AS b{i}" for i in range(K))
    ctes = [_feats_cte(), f"c0 AS (SELECT {mins}, {maxs} FROM feats)"]
    for t in range(1, rounds + 1):
        ctes.append(
            f"l{t} AS (SELECT f.*, CASE WHEN {_dist('a')} <= {_dist('b')} THEN 0 ELSE 1 END AS cluster "
            f"FROM feats f CROSS JOIN c{t - 1} c)"
        )
        avgs = ", ".join(f"avg(f{i}) AS m{i}" for i in range(K))
        ctes.append(f"u{t} AS (SELECT cluster, count(*) AS n, {avgs} FROM l{t} GROUP BY cluster)")
        keep_a = ", ".join(f"coalesce(u0.m{i}, c.a{i}) AS a{i}" for i in range(K))
        keep_b = ", ".join(f"coalesce(u1.m{i}, c.b{i}) AS b{i}" for i in range(K))
        ctes.append(
            f"c{t} AS (SELECT {keep_a}, {keep_b}, coalesce(u0.n, 0) AS n0, coalesce(u1.n, 0) AS n1 "
            f"FROM c{t - 1} c LEFT JOIN u{t} u0 ON u0.cluster = 0 LEFT JOIN u{t} u1 ON u1.cluster = 1)"
        )
    return "WITH " + ",\n".join(ctes + _scored_ctes(f"c{rounds}")) + "\n"


def _fit_ctes(feats: str) -> str:
    """feats, the distinct points, k-means++ seeds, Lloyd rounds of all runs up
    to their convergence, the best run, and what :func:`_scored_ctes` adds."""
    fs = ", ".join(f"f{i}" for i in range(K))
    point = ", ".join(f"CAST(floor(f{i} * 1000000.0 + 0.5) AS BIGINT)" for i in range(K))
    ab = [f"{p}{i}" for p in "ab" for i in range(K)]

    def picks(j: int, weight: str, source: str) -> str:
        digits = f"substr(md5(concat_ws(',', h, run, {j}, {lexicon.DEFAULT_SEED})), 1, 13)"
        u = f"(CAST(CAST('0x' || {digits} AS BIGINT) + 1 AS DOUBLE) / CAST({2**52} AS DOUBLE))"
        return (
            f"(SELECT * FROM (SELECT run, {fs}, row_number() OVER (PARTITION BY run ORDER BY -ln({u}) / ({weight}), {fs}) AS rn "
            f"FROM {source} WHERE {weight} > 0) WHERE rn = 1)"
        )

    def mean(cluster: int, i: int, old: str) -> str:
        among = f"FILTER (WHERE cl = {cluster})"
        return f"coalesce(sum(f{i} * w) {among} / sum(w) {among}, {old}{i})"

    moved = ", ".join([f"abs(x{i} - a{i})" for i in range(K)] + [f"abs(y{i} - b{i})" for i in range(K)])
    means = ", ".join([f"{mean(0, i, 'a')} AS x{i}" for i in range(K)] + [f"{mean(1, i, 'b')} AS y{i}" for i in range(K)])
    xy = ", ".join([f"x{i}" for i in range(K)] + [f"y{i}" for i in range(K)])
    ctes = [
        feats,
        f"pts AS MATERIALIZED (SELECT {fs}, CAST(count(*) AS DOUBLE) AS w, concat_ws(',', {point}) AS h FROM feats GROUP BY {fs})",
        f"s0 AS (SELECT run, " + ", ".join(f"f{i} AS a{i}" for i in range(K))
        + f" FROM {picks(0, 'w', f'pts CROSS JOIN (SELECT unnest(range({lexicon.DEFAULT_RUNS})) AS run)')})",
        # a run without a second point repeats its first
        f"s1 AS (SELECT c.*, " + ", ".join(f"coalesce(f.f{i}, c.a{i}) AS b{i}" for i in range(K))
        + f" FROM s0 c LEFT JOIN {picks(1, 'w * ' + _dist('a'), 'pts f CROSS JOIN s0 c')} f ON f.run = c.run)",
        f"it AS (SELECT run, 0 AS n, false AS done, {', '.join(ab)} FROM s1 UNION ALL "
        f"SELECT run, n + 1, greatest({moved}) < {lexicon.DEFAULT_TOL!r}, {xy} FROM ("
        f"SELECT run, n, {', '.join(ab)}, {means} FROM ("
        f"SELECT c.*, f.*, CASE WHEN {_dist('a')} <= {_dist('b')} THEN 0 ELSE 1 END AS cl FROM it c CROSS JOIN pts f "
        f"WHERE NOT c.done AND c.n < {lexicon.DEFAULT_MAX_ITER}) GROUP BY run, n, {', '.join(ab)}))",
        "last AS (SELECT * FROM it QUALIFY row_number() OVER (PARTITION BY run ORDER BY n DESC) = 1)",
        f"spread AS (SELECT c.run, sum(least({_dist('a')}, {_dist('b')}) * f.w) / sum(f.w) AS inertia "
        "FROM last c CROSS JOIN pts f GROUP BY c.run)",
        "best AS (SELECT last.*, inertia FROM last JOIN spread USING (run) ORDER BY round(inertia, 9), run LIMIT 1)",
    ]
    return "WITH RECURSIVE " + ",\n".join(ctes + _scored_ctes("best")) + "\n"


def _scored_ctes(centres: str) -> list[str]:
    """lf (distances and cluster), st, ai, and the scores, at the centres of
    a one-row table."""
    ctes = []
    ctes.append(
        f"lf AS (SELECT f.*, {_dist('a')} AS d0, {_dist('b')} AS d1, "
        f"CASE WHEN {_dist('a')} <= {_dist('b')} THEN 0 ELSE 1 END AS cluster "
        f"FROM feats f CROSS JOIN {centres} c)"
    )
    ctes.append(
        "st AS (SELECT sp.cluster, coalesce(count(lf.cluster), 0) AS n, coalesce(sum(lf.emoji_rate), 0.0) AS emoji_sum "
        "FROM (SELECT 0 AS cluster UNION ALL SELECT 1) sp LEFT JOIN lf ON lf.cluster = sp.cluster GROUP BY sp.cluster)"
    )
    ctes.append(
        "ai AS (SELECT CASE WHEN max(CASE WHEN cluster = 0 THEN emoji_sum / greatest(n, 1) END) > "
        "max(CASE WHEN cluster = 1 THEN emoji_sum / greatest(n, 1) END) THEN 0 ELSE 1 END AS ai_cluster FROM st)"
    )
    ctes.append(
        "sc AS (SELECT lf.*, 1.0 / (1.0 + d0) AS r0, 1.0 / (1.0 + d1) AS r1 FROM lf)"
    )
    ctes.append(
        "sc2 AS (SELECT sc.*, CASE WHEN r0 + r1 > 0 THEN r0 / (r0 + r1) ELSE r0 END AS s0, "
        "CASE WHEN r0 + r1 > 0 THEN r1 / (r0 + r1) ELSE r1 END AS s1 FROM sc)"
    )
    ctes.append(
        "sc3 AS (SELECT sc2.*, (CASE WHEN ai.ai_cluster = 0 THEN s0 ELSE s1 END) * 100.0 AS chance_ai FROM sc2 CROSS JOIN ai)"
    )
    ctes.append(
        "scored AS (SELECT sc3.*, 100.0 - chance_ai AS chance_human, "
        "CASE WHEN chance_ai >= 100.0 - chance_ai THEN 'AI' ELSE 'Human' END AS verdict FROM sc3)"
    )
    return ctes


def _js_fixed2(v: str) -> str:
    return (
        f"CASE WHEN {v} * 8 = floor({v} * 8) AND CAST(floor({v} * 8) AS BIGINT) % 2 = 1 "
        f"THEN printf('%.2f', (floor({v} * 100) + 1) / 100) ELSE printf('%.2f', {v}) END"
    )


def _plain_or(v: str, frac: str) -> str:
    return f"CASE WHEN {v} = floor({v}) THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE {frac} END"


def _family_count(f: str) -> str:
    return f"CAST(len(regexp_extract_all(_t2, {q(family_pattern(f))})) AS BIGINT) AS {f}"


def _md_parts_sql(source: str, key: str, text: str) -> str:
    cols = ", ".join([key] + [f"CAST(_md_{p} AS BIGINT) AS md_{p}" for p in MD_PARTS])
    return S.sql_steps(source, md.markdown_steps(text), f"SELECT {cols} FROM {{src}}", "d")


def oracle() -> dict[str, str]:
    out: dict[str, str] = {}
    norm = _norm()
    out["normalize_text"] = (
        f"WITH nt AS ({norm}) SELECT doc_id, md5(_t1) AS t1_md5, md5(_t2) AS t2_md5, "
        "CAST(length(_t1) AS BIGINT) AS t1_len, CAST(length(_t2) AS BIGINT) AS t2_len FROM nt"
    )
    out["sentence_count"] = f"WITH m AS ({_metrics()}) SELECT doc_id, CAST(sentence_count AS BIGINT) AS sentence_count FROM m"
    out["split_sentences"] = (
        f"WITH nt AS ({norm}), sp AS (SELECT doc_id, list_filter(regexp_split_to_array(_t1, {q(SENTENCE_SPLIT)}), "
        f"lambda x: regexp_matches(x, {q(NON_BLANK)})) AS l FROM nt) "
        "SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS sentence FROM sp"
    )
    out["split_words"] = (
        f"WITH nt AS ({norm}), sp AS (SELECT doc_id, list_filter(regexp_split_to_array(_t2, {q(WORD_SPLIT)}), "
        "lambda x: x <> '') AS l FROM nt) "
        "SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS word FROM sp"
    )
    out["split_lines"] = (
        f"WITH nt AS ({norm}), sp AS (SELECT doc_id, CASE WHEN _t1 = '' THEN []::VARCHAR[] ELSE "
        f"list_transform(string_split(_t1, chr(10)), lambda x: regexp_replace(x, {q(chr(13) + '$')}, '')) END AS l FROM nt) "
        "SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS line FROM sp"
    )
    out["graphemes"] = "SELECT doc_id, CAST(length_grapheme(text) AS BIGINT) AS n_graphemes FROM documents"
    out["emoji_rate"] = f"WITH m AS ({_metrics()}) SELECT doc_id, {_round('emoji_rate')} AS emoji_rate FROM m"
    out["buzzword_rate"] = f"WITH m AS ({_metrics()}) SELECT doc_id, {_round('buzzword_rate')} AS buzzword_rate FROM m"
    out["phrase_family_counts"] = (
        f"WITH nt AS ({norm}) SELECT doc_id, " + ", ".join(_family_count(f) for f in FAMILY_ORDER) + " FROM nt"
    )
    hits = " UNION ALL ".join(
        f"SELECT {q(f)} AS family, unnest(regexp_extract_all(_t2, {q(family_pattern(f))})) AS phrase FROM nt"
        for f in FAMILY_ORDER
    )
    out["phrase_hits"] = f"WITH nt AS ({norm}) SELECT family, phrase, count(*) AS n FROM ({hits}) h GROUP BY family, phrase"
    out["lexicon_join_counts"] = out["phrase_family_counts"]
    out["lexicon_join_totals"] = out["phrase_hits"]
    out["char_marks"] = (
        f"WITH m AS ({_metrics()}) SELECT doc_id, CAST(irregular_dashes AS BIGINT) AS dashes, "
        "CAST(irregular_arrows AS BIGINT) AS arrows, CAST(irregular_quotations AS BIGINT) AS quotes, "
        "CAST(irregular_ellipsis AS BIGINT) AS ellipsis FROM m"
    )
    out["html_escapes"] = f"WITH m AS ({_metrics()}) SELECT doc_id, CAST(html_escape_count AS BIGINT) AS html_escape_count FROM m"
    out["markdown_markers"] = _md_parts_sql("(SELECT page_id, html FROM pages) AS pg", "page_id", "html")
    out["markdown_marked_docs"] = _md_parts_sql(MARKED, "doc_id", "text")
    out["markup_events"] = events_sql(MARKED, "doc_id", "text")
    out["markup_events_pages"] = events_sql("(SELECT page_id, replace(html, '<', chr(10) || '<') AS html FROM pages) AS pg", "page_id", "html")
    out["labels"] = f"WITH m AS ({_metrics()}) SELECT doc_id, CAST(labels AS BIGINT) AS labels FROM m"
    out["hashtags"] = f"WITH m AS ({_metrics()}) SELECT doc_id, CAST(hashtags AS BIGINT) AS hashtags FROM m"
    out["text_metrics"] = f"WITH m AS ({_metrics()}) SELECT {_metrics_out('doc_id')} FROM m"
    out["text_metrics_plain"] = (
        f"WITH m AS ({_metrics('(SELECT doc_id, text FROM documents) AS d0', 'text', ('doc_id',))}) "
        f"SELECT {_metrics_out('doc_id')} FROM m"
    )
    out["text_metrics_pages"] = (
        f"WITH m AS ({_metrics('(SELECT page_id, html FROM pages) AS p0', 'html', ('page_id',))}) "
        f"SELECT {_metrics_out('page_id')} FROM m"
    )
    conv_cols = ", ".join(["conv_id", "turn"] + [f"{_round(m)} AS {m}" for m in METRICS]
                          + ["CAST(sentence_count AS BIGINT) AS sentence_count"])
    out["text_metrics_conversations"] = (
        f"WITH m AS ({_metrics('(SELECT conv_id, turn, text FROM conversations) AS c0', 'text', ('conv_id', 'turn'))}) "
        f"SELECT {conv_cols} FROM m"
    )
    out["feature_vector"] = (
        f"WITH {_feats_cte()} SELECT doc_id, " + ", ".join(f"{_round(f)} AS {f}" for f in FEATS) + " FROM feats"
    )
    ll = _lloyd_ctes()
    out["linf_assign"] = (
        f"WITH {_feats_cte()}, c0 AS (SELECT "
        + ", ".join(f"min(f{i}) AS a{i}" for i in range(K)) + ", "
        + ", ".join(f"max(f{i}) AS b{i}" for i in range(K))
        + f" FROM feats) SELECT f.doc_id, {_round(_dist('a'))} AS d0, {_round(_dist('b'))} AS d1, "
        f"CAST(CASE WHEN {_dist('a')} <= {_dist('b')} THEN 0 ELSE 1 END AS BIGINT) AS cluster FROM feats f CROSS JOIN c0 c"
    )
    cT = f"c{LLOYD_ROUNDS}"
    out["lloyd_3_rounds"] = (
        ll
        + f"SELECT CAST(0 AS BIGINT) AS cluster, CAST(n0 AS BIGINT) AS n, "
        + ", ".join(f"{_round(f'a{i}')} AS f{i}" for i in range(K))
        + f" FROM {cT} UNION ALL SELECT CAST(1 AS BIGINT), CAST(n1 AS BIGINT), "
        + ", ".join(_round(f"b{i}") for i in range(K))
        + f" FROM {cT}"
    )
    out["inertia_at_centres"] = (
        f"WITH {_feats_cte()}, c0 AS (SELECT "
        + ", ".join(f"min(f{i}) AS a{i}" for i in range(K)) + ", "
        + ", ".join(f"max(f{i}) AS b{i}" for i in range(K))
        + f" FROM feats) SELECT {_round('avg(least(' + _dist('a') + ', ' + _dist('b') + '))')} AS inertia, "
        "CAST(count(*) AS BIGINT) AS n FROM feats f CROSS JOIN c0 c"
    )
    out["cluster_emoji_mean"] = (
        ll + "SELECT CAST(cluster AS BIGINT) AS cluster, CAST(n AS BIGINT) AS n, "
        f"{_round('emoji_sum')} AS emoji_sum, {_round('emoji_sum / greatest(n, 1)')} AS emoji_mean FROM st"
    )
    out["name_ai_cluster"] = ll + "SELECT CAST(ai_cluster AS BIGINT) AS ai_cluster FROM ai"
    out["point_confidence"] = (
        ll + f"SELECT doc_id, {_round('d0')} AS d0, {_round('d1')} AS d1, {_round('s0')} AS s0, {_round('s1')} AS s1 FROM sc2"
    )
    score_sel = f"SELECT doc_id, {_round('chance_ai')} AS chance_ai, {_round('chance_human')} AS chance_human, verdict FROM scored"
    out["score"] = ll + score_sel
    out["score_texts"] = ll + score_sel
    out["score_stream"] = ll + score_sel
    out["verdict"] = ll + "SELECT doc_id, verdict, CAST(cluster AS BIGINT) AS cluster FROM scored"
    entries = ", ".join(
        f"{{'k': -{m}, 'ord': {i}, 'name': {q(m)}, 'value': {m}}}" for i, m in enumerate(METRICS)
    )
    line = f"'  ' || x.name || ': ' || ({_plain_or('x.value', _js_fixed2('x.value'))})"
    out["nonzero_metrics"] = (
        f"WITH m AS ({_metrics()}), l AS (SELECT doc_id, list_sort(list_filter([{entries}], lambda x: x.value <> 0)) AS nz FROM m) "
        f"SELECT doc_id, array_to_string(list_transform(nz, lambda x: {line}), chr(10)) AS nonzero_text, "
        "CAST(len(nz) AS BIGINT) AS n_nonzero FROM l"
    )
    panel = (
        "'Text is most likely ' || verdict || chr(10) || chr(10) || 'Chance:' || chr(10) || '  AI    = ' || "
        f"({_js_fixed2('chance_ai')}) || '%' || chr(10) || '  Human = ' || ({_js_fixed2('chance_human')}) || '%' || "
        "chr(10) || chr(10) || 'Non-zero metrics:' || chr(10) || "
        f"array_to_string(list_transform(list_sort(list_filter([{entries}], lambda x: x.value <> 0)), lambda x: {line}), chr(10))"
    )
    mcols = ", ".join(f"m.{c}" for c in METRICS)
    out["score_display"] = (
        ll.rstrip() + f",\nmm AS ({_metrics()})\n"
        f"SELECT doc_id, {panel} AS display FROM (SELECT doc_id, chance_ai, chance_human, verdict FROM scored) s "
        f"JOIN (SELECT doc_id, {mcols} FROM mm m) m USING (doc_id)"
    )
    sentries = ", ".join(f"{{'name': {q(short)}, 'value': {m}}}" for short, m in lexicon.SUMMARY_NAMES)
    cell = (
        "(CASE WHEN i = 1 THEN '' WHEN (i - 1) % 2 = 0 THEN '          ' ELSE chr(9) || chr(9) END) || "
        f"rpad(x.name, 10, ' ') || ({_plain_or('x.value', "printf('%.1f', x.value)")}) || "
        "(CASE WHEN (i - 1) % 2 = 1 THEN chr(10) ELSE '' END)"
    )
    out["metrics_summary"] = (
        f"WITH m AS ({_metrics()}), l AS (SELECT doc_id, list_filter([{sentries}], lambda x: x.value <> 0) AS nz FROM m) "
        f"SELECT doc_id, array_to_string(list_transform(nz, lambda x, i: {cell}), '') AS summary FROM l"
    )
    counts = (
        "cnt AS (SELECT CAST(sum(CASE WHEN lf.cluster = ai.ai_cluster THEN 1 ELSE 0 END) AS BIGINT) AS ai, "
        "CAST(sum(CASE WHEN lf.cluster = ai.ai_cluster THEN 0 ELSE 1 END) AS BIGINT) AS human, max(ai.ai_cluster) AS ai_cluster "
        "FROM lf CROSS JOIN ai)"
    )
    out["cluster_report"] = (
        ll.rstrip() + ",\n" + counts + "\n"
        "SELECT CAST(ai_cluster AS BIGINT) AS ai_cluster, ai, human, ai + human AS total, "
        "round(human * 100.0 / (ai + human), 2) AS human_pct, round(ai * 100.0 / (ai + human), 2) AS ai_pct, "
        f"strftime(DATE {q(REPORT_DATE)}, '%b %-d, %Y') AS date, format('{{:,}}', human) AS human_text, "
        "format('{:,}', ai) AS ai_text, printf('%.2f', round(human * 100.0 / (ai + human), 2)) AS human_pct_text, "
        "printf('%.2f', round(ai * 100.0 / (ai + human), 2)) AS ai_pct_text FROM cnt"
    )
    fitted = _fit_ctes(_feats_cte())
    out["kmeans_fit"] = fitted + " UNION ALL ".join(
        f"SELECT CAST({c} AS BIGINT) AS cluster, ai_cluster = {c} AS is_ai, "
        + ", ".join(f"{_round(f'{p}{i}')} AS c{i}" for i in range(K))
        + f", {_round('inertia')} AS inertia, CAST(n AS BIGINT) AS n_iter, done AS converged, CAST(run AS BIGINT) AS run "
        "FROM best CROSS JOIN ai"
        for c, p in enumerate("ab")
    )
    out["score_fitted"] = fitted + score_sel
    out["score_own_weights"] = _fit_ctes(_feats_cte(weights=OWN_WEIGHTS, lexicons=OWN_LEXICONS)) + score_sel
    line_cols = (
        f"strftime(DATE {q(REPORT_DATE)}, '%b %-d, %Y') AS date, format('{{:,}}', human) AS human, "
        "format('{:,}', ai) AS ai, printf('%.2f', round(human * 100.0 / (ai + human), 2)) AS human_pct, "
        "printf('%.2f', round(ai * 100.0 / (ai + human), 2)) AS ai_pct, CAST({n_null} AS BIGINT) AS n_null"
    )
    out["training_report"] = (
        fitted.rstrip() + ",\n" + counts + "\nSELECT "
        + line_cols.replace("{n_null}", f"(SELECT count(*) FROM {MARKED} WHERE text IS NULL)") + " FROM cnt"
    )
    feeds_src = (
        "(SELECT text FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations) WHERE text IS NOT NULL) AS un"
    )
    out["train_from_feeds"] = (
        _fit_ctes(_feats_cte(feeds_src, ("text",))).rstrip() + ",\n" + counts + "\nSELECT CAST(ai_cluster AS BIGINT) AS ai_cluster, "
        + line_cols.replace("{n_null}", "0") + ", CAST((SELECT n FROM best) AS BIGINT) AS rounds FROM cnt"
    )
    by = (
        "SELECT {g}, CAST(sum(CASE WHEN lf.cluster = ai.ai_cluster THEN 1 ELSE 0 END) AS BIGINT) AS ai, "
        "CAST(sum(CASE WHEN lf.cluster <> ai.ai_cluster THEN 1 ELSE 0 END) AS BIGINT) AS human, "
        "count(*) FILTER (WHERE lf.cluster IS NULL) AS n_null FROM lf CROSS JOIN ai GROUP BY {grp}"
    )
    shares = (
        "SELECT {g}, ai, human, ai + human AS total, round(human * 100.0 / (ai + human), 2) AS human_pct, "
        "round(ai * 100.0 / (ai + human), 2) AS ai_pct, n_null FROM ({inner}) b"
    )
    out["report_by_lang"] = ll + shares.format(g="lang", inner=by.format(g="lang", grp="lang"))
    out["report_by_source_rollup"] = ll + shares.format(g="source", inner=by.format(g="source", grp="ROLLUP (source)"))
    out["report_null_rows"] = ll + shares.format(g="lang", inner=by.format(g="lang", grp="lang").replace(
        "FROM lf", "FROM (SELECT doc_id, lang, CASE WHEN doc_id % 11 <> 0 THEN cluster END AS cluster FROM lf) lf"))
    union_src = (
        f"(SELECT 'documents' AS kind, text FROM ({marked_sql(('doc_id', 'text'))}) d "
        "UNION ALL SELECT 'conversations' AS kind, text FROM conversations) AS un"
    )
    ufs = ", ".join(f"{m} * {float(w)!r} AS f{i}" for i, (m, w) in enumerate(lexicon.FEATURE_WEIGHTS))
    out["report_by_kind"] = (
        ll.rstrip() + f",\num AS ({_metrics(union_src, 'text', ('kind',))}),\n"
        f"uf AS (SELECT kind, {ufs} FROM um),\n"
        f"ul AS (SELECT f.kind, CASE WHEN {_dist('a')} <= {_dist('b')} THEN 0 ELSE 1 END AS cluster "
        f"FROM uf f CROSS JOIN c{LLOYD_ROUNDS} c)\n"
        + shares.format(g="kind", inner=by.format(g="kind", grp="kind").replace("FROM lf CROSS JOIN ai", "FROM ul lf CROSS JOIN ai"))
    )
    out["sample_per_cluster"] = (
        ll + "SELECT CAST(cluster AS BIGINT) AS cluster, doc_id, CAST(rk AS BIGINT) AS sample_rank FROM ("
        "SELECT cluster, doc_id, row_number() OVER (PARTITION BY cluster ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'), doc_id) AS rk "
        "FROM lf) s WHERE rk <= 5"
    )
    out["cluster_samples"] = (
        ll.rstrip() + f",\nmm AS ({_metrics()}),\n"
        f"sm AS (SELECT doc_id, array_to_string(list_transform(list_filter([{sentries}], lambda x: x.value <> 0), "
        f"lambda x, i: {cell}), '') AS summary FROM mm),\n"
        "pick AS (SELECT cluster, doc_id, row_number() OVER (PARTITION BY cluster ORDER BY "
        "md5(CAST(doc_id AS VARCHAR) || '-42'), doc_id) AS rk FROM lf)\n"
        f"SELECT CAST(p.cluster AS BIGINT) AS cluster, CAST(p.rk AS BIGINT) AS sample_rank, p.doc_id, sm.summary, "
        f"md5(t.text) AS text_md5 FROM pick p JOIN sm USING (doc_id) JOIN ({marked_sql(('doc_id', 'text'))}) t "
        "USING (doc_id) WHERE p.rk <= 5"
    )
    union = (
        "SELECT {k} AS kind, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM documents UNION ALL "
        "SELECT {k2}, CAST(length(text) AS BIGINT), md5(text) FROM conversations"
    )
    out["corpus_union"] = union.format(k="'documents'", k2="'conversations'")
    out["paged_json"] = union.format(k="'devlogs'", k2="'projects'")
    # documents landed 100 per page, hashed by row: every page is filled
    out["page_audit"] = (
        "SELECT CAST(ceil(count(*) / 100.0) AS BIGINT) AS pages_found, CAST(ceil(count(*) / 100.0) AS BIGINT) AS pages_expected, "
        "CAST(count(*) AS BIGINT) AS items, true AS complete FROM documents"
    )
    ranked = "row_number() OVER (PARTITION BY {by} ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'), doc_id) AS rk"
    out["score_stream_samples"] = (
        ll + "SELECT lang, verdict, doc_id, CAST(rk AS BIGINT) AS sample_rank FROM (SELECT d.lang, s.verdict, doc_id, "
        + ranked.format(by="d.lang, s.verdict") + " FROM scored s JOIN documents d USING (doc_id)) WHERE rk <= 5"
    )
    ids = "coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rk) FILTER (WHERE rk <= 3 AND {of}is_ai), '')"
    out["report_samples_by_lang"] = (
        ll + "SELECT lang, CAST(count(*) FILTER (WHERE is_ai) AS BIGINT) AS ai, CAST(count(*) FILTER (WHERE NOT is_ai) AS BIGINT) AS human, "
        "round(count(*) FILTER (WHERE is_ai) * 100.0 / count(*), 2) AS ai_pct, CAST(0 AS BIGINT) AS n_null, "
        f"{ids.format(of='')} AS ai_sample, {ids.format(of='NOT ')} AS human_sample FROM (SELECT lang, doc_id, is_ai, "
        + ranked.format(by="lang, is_ai") + " FROM (SELECT lang, doc_id, lf.cluster = ai.ai_cluster AS is_ai FROM lf CROSS JOIN ai)) GROUP BY lang"
    )
    out["page_lines"] = out["paged_json"]
    out["page_lines_audit"] = " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages_expected, CAST(count(*) AS BIGINT) AS items, "
        f"CAST(0 AS BIGINT) AS n_corrupt, CAST(0 AS BIGINT) AS n_repeated, true AS all_found FROM {t}"
        for kind, t in (("devlogs", "documents"), ("projects", "conversations"))
    )
    return out
