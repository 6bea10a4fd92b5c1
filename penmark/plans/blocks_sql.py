"""DuckDB twin of the block-state fold: lines walked by a recursive query. It
shares the inline patterns with the Spark side, and no block pattern."""

from __future__ import annotations

from ..functions import markdown as md
from ..functions.blocks import BLOCK_TAGS, COUNTS
from ..functions.spec import sql_str as q

RAW = "('script', 'pre', 'style', 'textarea')"
LONE_TAG = (
    r"<[A-Za-z][A-Za-z0-9-]*( +[A-Za-z_:][A-Za-z0-9_.:-]*( *= *([^ \"'=<>`]+|'[^']*'|\"[^\"]*\"))?)* */?> *"
    r"|</[A-Za-z][A-Za-z0-9-]* *> *"
)


def _inline() -> str:
    """CTEs i0 ... i6 over ``ln``: the line less what was counted, and the count."""
    masked = f"regexp_replace(regexp_replace(line, {q(md.CODE_SPAN)}, 'x', 'g'), {q(md.ESCAPE)}, 'x', 'g')"
    out = [f"i0 AS (SELECT key, i, line, {masked} AS src, 0 AS n FROM ln)"]
    for at, p in enumerate((md.IMAGE, md.LINK, md.AUTOLINK, md.HTML, md.STRONG, md.EMPHASIS), start=1):
        out.append(
            f"i{at} AS (SELECT key, i, line, regexp_replace(src, {q(p)}, 'x', 'g') AS src, "
            f"n + len(regexp_extract_all(src, {q(p)})) AS n FROM i{at - 1})"
        )
    return ", ".join(out)


def events_sql(source: str, key: str, text: str) -> str:
    tags = ", ".join(q(t) for t in BLOCK_TAGS)
    counts = ", ".join(COUNTS)
    split = "string_split(replace(replace(replace(text, chr(9), '    '), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"
    squeezed = "replace(body, ' ', '')"
    rule = f"length({squeezed}) >= 3 AND (" + " OR ".join(f"trim({squeezed}, '{c}') = ''" for c in "*-_") + ")"
    under = "body <> '' AND (trim(rtrim(body, ' '), '=') = '' OR trim(rtrim(body, ' '), '-') = '') AND substr(body, 1, 1) IN ('=', '-')"
    bare = "rtrim(core, ' ')"
    return f"""
WITH RECURSIVE src AS (SELECT {key} AS key, {text} AS text FROM {source}),
ln AS (SELECT key, unnest(l) AS line, CAST(generate_subscripts(l, 1) AS INT) AS i FROM (SELECT key, {split} AS l FROM src)),
{_inline()},
f1 AS (SELECT key, i, line, n AS n_inline, regexp_extract(line, '^( ? ? ?> ?)*') AS pre FROM i6),
f2 AS (SELECT key, i, n_inline, substr(line, length(pre) + 1) AS rest, CAST(length(pre) - length(replace(pre, '>', '')) AS INT) AS depth FROM f1),
f3 AS (SELECT *, ltrim(rest, ' ') AS body FROM f2),
f4 AS (SELECT *, CAST(length(rest) - length(body) AS INT) AS indent, {rule} AS is_rule, {under} AS is_under FROM f3),
f5 AS (SELECT *, CAST(CASE WHEN is_rule THEN 0 ELSE length(regexp_extract(body, '^([*+-]|[0-9]{{1,9}}[).])( +|$)')) END AS INT) AS mark FROM f4),
f6 AS (SELECT *, substr(body, mark + 1) AS core FROM f5),
f7 AS (SELECT *, lower(core) AS low, ltrim(core, '#') AS no_hash, ltrim(core, '`') AS no_tick, ltrim(core, '~') AS no_wave,
  regexp_extract(lower(core), '^</?([a-z][a-z0-9-]*)', 1) AS tag FROM f6),
f8 AS (SELECT *, substr(low, length(tag) + CASE WHEN starts_with(low, '</') THEN 3 ELSE 2 END) AS behind FROM f7),
f AS MATERIALIZED (SELECT key, i, n_inline, depth, indent, is_rule, is_under, mark, body = '' AS is_blank, core = '' AS is_empty,
  mark > 0 AND ascii(body) BETWEEN 48 AND 57 AND substr(body, 1, 2) NOT IN ('1.', '1)') AS is_late,
  length(core) - length(no_hash) BETWEEN 1 AND 6 AND substr(no_hash, 1, 1) IN ('', ' ') AS is_atx,
  CAST(CASE WHEN length(core) - length(no_tick) >= 3 AND NOT contains(no_tick, '`') THEN length(core) - length(no_tick)
    WHEN length(core) - length(no_wave) >= 3 THEN length(core) - length(no_wave) ELSE 0 END AS INT) AS ticks,
  substr(core, 1, 1) AS sign, length({bare}) >= 3 AND (trim({bare}, '`') = '' OR trim({bare}, '~') = '') AS is_bare,
  CASE WHEN NOT starts_with(low, '</') AND tag IN {RAW} AND substr(behind, 1, 1) IN ('', ' ', '>') THEN 1
    WHEN starts_with(low, '<!--') THEN 2 WHEN starts_with(low, '<?') THEN 3 WHEN regexp_matches(low, '^<![a-z]') THEN 4
    WHEN starts_with(core, '<![CDATA[') THEN 5
    WHEN tag IN ({tags}) AND (substr(behind, 1, 1) IN ('', ' ', '>') OR starts_with(behind, '/>')) THEN 6
    WHEN regexp_full_match(core, {q(LONE_TAG)}) THEN 7 ELSE 0 END AS opens,
  [regexp_matches(lower(rest), '</(script|pre|style|textarea)>'), contains(rest, '-->'), contains(rest, '?>'), contains(rest, '>'),
    contains(rest, ']]>')] AS ends FROM f8),
r AS (
  SELECT key, 0 AS i, 0 AS quote, []::INT[] AS items, false AS para, false AS code, '' AS ch, 0 AS fence, 0 AS html, 0 AS col,
    {", ".join(f"0 AS {c}" for c in COUNTS)} FROM src WHERE text IS NOT NULL
  UNION ALL
  SELECT key, i, CASE WHEN kind IN ('fence', 'html', 'more') THEN quote ELSE depth END, now, kind = 'more' OR (kind = 'text' AND NOT is_empty),
    kind = 'code' OR (kind = 'blank' AND code AND same), CASE WHEN kind = 'opens fence' THEN sign ELSE ch END,
    CASE WHEN kind = 'opens fence' THEN ticks
      WHEN kind = 'fence' AND NOT (same AND is_bare AND mark = 0 AND sign = ch AND ticks >= fence AND indent - col < 4) THEN fence ELSE 0 END,
    CASE WHEN kind = 'opens html' THEN CASE WHEN opens < 6 AND ends[opens] THEN 0 ELSE opens END
      WHEN kind = 'html' THEN CASE WHEN html < 6 AND ends[html] THEN 0 ELSE html END ELSE 0 END,
    CASE WHEN kind IN ('opens fence', 'opens html') THEN coalesce(list_max(now), 0) WHEN kind IN ('fence', 'html') THEN col ELSE 0 END,
    fences + CAST(kind = 'opens fence' AS INT), indented + CAST(kind = 'code' AND NOT (code AND same AND flat) AS INT),
    quotes + CASE WHEN kind IN ('fence', 'html') THEN 0 ELSE greatest(depth - quote, 0) END,
    atx + CAST(kind = 'atx' AS INT), setext + CAST(kind = 'setext' AS INT), rules + CAST(kind = 'rule' AS INT),
    html_lines + CAST(kind IN ('html', 'opens html') AS INT),
    inline + CASE WHEN kind IN ('more', 'atx', 'text') THEN CAST(n_inline AS INT) ELSE 0 END
  FROM (
    SELECT *, CASE WHEN kind IN ('fence', 'html', 'setext', 'more') THEN items WHEN kind = 'blank' THEN held
      WHEN marks AND kind <> 'code' THEN list_append(kept, indent + mark) ELSE kept END AS now
    FROM (
      SELECT *, CASE WHEN fence > 0 AND within THEN 'fence'
        WHEN html > 0 AND within AND NOT (html >= 6 AND is_blank AND depth <= quote) THEN 'html' WHEN is_blank THEN 'blank'
        WHEN here AND is_under AND near AND flat THEN 'setext'
        WHEN ((para AND depth < quote) OR here) AND NOT (marks OR (near AND mark = 0 AND (is_atx OR ticks > 0 OR is_rule OR opens BETWEEN 1 AND 6))) THEN 'more'
        WHEN NOT near THEN 'code' WHEN is_rule THEN 'rule' WHEN is_atx THEN 'atx' WHEN ticks > 0 THEN 'opens fence'
        WHEN opens > 0 THEN 'opens html' ELSE 'text' END AS kind
      FROM (
        SELECT *, near AND mark > 0 AND NOT (here AND (is_empty OR is_late)) AS marks
        FROM (
          SELECT *, indent - coalesce(list_max(kept), 0) < 4 AS near, len(kept) = len(held) AS flat, para AND same AS here,
            depth > quote OR (same AND (is_blank OR indent >= col)) AS within
          FROM (
            SELECT *, list_filter(held, lambda c: c <= indent) AS kept
            FROM (
              SELECT r.* EXCLUDE (i), f.* EXCLUDE (key), f.depth = r.quote AS same, CASE WHEN f.depth = r.quote THEN r.items ELSE []::INT[] END AS held
              FROM r JOIN f ON r.key = f.key AND f.i = r.i + 1)))))))
, last AS (SELECT key AS k, {counts} FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1)
SELECT key AS {key}, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in COUNTS)}, bullet, {" + ".join(f"CAST({c} AS BIGINT)" for c in COUNTS)} + bullet AS total
FROM (SELECT key, CAST(len(regexp_extract_all(text, {q(md.BULLET)})) AS BIGINT) AS bullet FROM src) LEFT JOIN last ON key = k
"""
