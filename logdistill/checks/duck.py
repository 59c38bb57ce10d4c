"""Building blocks of the DuckDB statements the queries are checked against.

RE2 has no lookaround, so the rules that need it are stated with captured context
or with a marker character; everything else uses the fixed patterns as they are.
"""

from __future__ import annotations

from logdistill.checks.views import LOGS_SQL
from logdistill.config import DEFAULTS, Config
from logdistill.functions import patterns as P
from logdistill.functions.text import LINE_BREAK, WS_CHARS, active_rules

MARK = "\ue001"
GUARD = "\ue000_"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(expr: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(replacement)}, 'g')"


def strip(expr: str) -> str:
    return f"trim({expr}, {lit(WS_CHARS)})"


def first(expr: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({expr}, {lit(pattern)}, {group}), '')"


def backrefs(replacement: str) -> str:
    return replacement.replace("$1", r"\1").replace("$2", r"\2")


def phone_steps(expr: str) -> str:
    """The phone rule without lookaround: a mark stands where a number may begin."""
    marked = sub(f"'{MARK}' || {expr}", r"([^\d.])", r"\1" + MARK)
    # The leading mark gets a mark of its own; keep just one.
    marked = f"replace({marked}, '{MARK}{MARK}', '{MARK}')"
    sep = rf"(?:[ -]{MARK}|\.)?"
    core = (
        rf"{MARK}(?:\+{MARK})?\d{{1,3}}{sep}(?:\({MARK})?\d{{2,4}}(?:\){MARK})?{sep}\d{{3,4}}{sep}\d{{3,4}}"
    )
    replaced = sub(marked, core + r"([^\d.]|$)", r"[PHONE]\1")
    return f"replace({replaced}, '{MARK}', '')"


def redacted(expr: str, cfg: Config = DEFAULTS) -> str:
    for rule in active_rules(cfg):
        if rule.name == "phone":
            expr = phone_steps(expr)
        else:
            expr = sub(expr, rule.pattern, backrefs(rule.replacement))
    return expr


def template_step(expr: str, name: str, pattern: str, replacement: str) -> str:
    if name == "port":
        marked = sub(expr, r"([a-zA-Z0-9\]]):", r"\1" + MARK + ":")
        return f"replace({sub(marked, MARK + r':\d{2,5}' + chr(92) + 'b', ':<PORT>')}, '{MARK}', '')"
    if name == "quantity":
        return sub(
            expr, r"\b\d+(?:\.\d+)?(\s?(?:ms|s|sec|seconds|MB|KB|GB|bytes)\b)", r"<NUM>\1"
        )
    if name == "path_segment":
        once = sub(expr, r"/\d+(/|\s|$|[?\"'])", r"/<id>\1")
        return sub(once, r"/\d+(/|\s|$|[?\"'])", r"/<id>\1")
    return sub(expr, pattern, replacement)


def normalized(expr: str) -> str:
    for rule in P.TEMPLATE_RULES:
        expr = template_step(expr, rule.name, rule.pattern, rule.replacement)
    expr = sub(expr, P.STATUS_GUARD, r"\1" + GUARD + r"\2")
    expr = sub(expr, P.REMAINING_NUMBER, "<ID>")
    expr = f"replace({expr}, '{GUARD}', '')"
    return strip(sub(expr, P.BLANK_RUN, " "))


def endpoint_normalized(expr: str) -> str:
    once = sub(expr, r"/\d+(/|$)", r"/<id>\1")
    return sub(once, r"/\d+(/|$)", r"/<id>\1")


def json_string(key: str) -> str:
    return (
        f"CASE WHEN json_type(j, '$.{key}') = 'VARCHAR' THEN nullif(json_extract_string(j, '$.{key}'), '') END"
    )


def first_string(keys) -> str:
    return "coalesce(" + ", ".join(json_string(k) for k in keys) + ")"


def json_endpoint() -> str:
    parts = []
    for k in P.ENDPOINT_KEYS:
        parts.append(f"CASE WHEN ({json_string(k)}) LIKE '/%' THEN {json_string(k)} END")
    return "coalesce(" + ", ".join(parts) + ")"


def json_status() -> str:
    parts = []
    for k in P.STATUS_KEYS:
        text = f"json_extract_string(j, '$.{k}')"
        ok = (
            f"(json_type(j, '$.{k}') IN ('UBIGINT', 'BIGINT') OR (json_type(j, '$.{k}') = 'VARCHAR'"
            f" AND regexp_full_match({text}, '[0-9]+')))"
        )
        parts.append(
            f"CASE WHEN {ok} AND try_cast({text} AS INTEGER) BETWEEN 100 AND 599"
            f" THEN try_cast({text} AS INTEGER) END"
        )
    return "coalesce(" + ", ".join(parts) + ")"


def fingerprint(*parts: str) -> str:
    joined = " || chr(10) || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"substr(sha256({joined}), 1, 16)"


LOGS = f"logs AS ({LOGS_SQL})"

FIELDS = f"""fields AS (
  SELECT *, upper({first_string(P.LEVEL_KEYS)}) AS jlevel,
    {first_string(P.REQUEST_ID_KEYS)} AS request_id, {first_string(P.TRACE_ID_KEYS)} AS trace_id,
    {first_string(P.SERVICE_KEYS)} AS service, {json_endpoint()} AS jendpoint, {json_status()} AS jstatus
  FROM (SELECT *, CASE WHEN {strip('message')} LIKE '{{%}}' AND json_valid({strip('message')})
               THEN {strip('message')} END AS j FROM logs) x)"""


def red_cte(cfg: Config = DEFAULTS) -> str:
    return f"""red AS (
  SELECT event_id, ts, log_group, log_stream, message AS raw, {redacted('message', cfg)} AS message,
    jlevel, request_id, trace_id, service, {redacted('jendpoint', cfg)} AS jendpoint, jstatus
  FROM fields)"""


TRACES = f"""tl AS (
  SELECT event_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (
    SELECT event_id, string_split_regex(message, {lit(LINE_BREAK.replace(chr(92) + 'u2028', chr(92) + 'x{2028}').replace(chr(92) + 'u2029', chr(92) + 'x{2029}'))}) AS ls
    FROM red WHERE regexp_matches(message, '(?m)^Traceback \\(most recent call last\\):')) x),
tok AS (
  SELECT event_id, i, regexp_extract(l, {lit(P.TRACE_FRAME)}, 1) AS f,
    regexp_extract(l, {lit(P.TRACE_FRAME)}, 2) AS ln, regexp_extract(l, {lit(P.TRACE_FRAME)}, 3) AS fn,
    regexp_extract({strip('l')}, {lit(P.TRACE_EXCEPTION)}, 1) AS et,
    {strip(f"regexp_extract({strip('l')}, {lit(P.TRACE_EXCEPTION)}, 2)")} AS em FROM tl),
tk AS (
  SELECT *, lag(f) OVER (PARTITION BY event_id ORDER BY i) AS pf FROM tok WHERE f <> '' OR et <> ''),
ends AS (
  SELECT *, CASE WHEN et <> '' AND coalesce(pf, '') <> '' THEN 1 ELSE 0 END AS e FROM tk),
parts AS (
  SELECT *, sum(e) OVER (PARTITION BY event_id ORDER BY i ROWS UNBOUNDED PRECEDING) - e AS eno FROM ends),
tr AS (
  SELECT event_id, string_agg(et, '>' ORDER BY i DESC) FILTER (e = 1) AS chain, sum(e) AS n,
    min_by(et, i) FILTER (e = 1) AS root_type, min_by(em, i) FILTER (e = 1) AS root_message
  FROM parts GROUP BY event_id HAVING sum(e) > 0),
rf AS (
  SELECT event_id, string_agg(f || ':' || CASE WHEN fn = '' THEN '?' ELSE fn END, '|' ORDER BY i) AS frames
  FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY i DESC) AS back
        FROM parts WHERE eno = 0 AND f <> '') x WHERE back <= 5 GROUP BY event_id)"""

_TEMPLATE = normalized("CASE WHEN tr.event_id IS NULL THEN red.message ELSE tr.root_type || ': ' || tr.root_message END")

ENRICHED = f"""named AS (
  SELECT red.*, tr.chain, rf.frames,
    {endpoint_normalized(f"coalesce(jendpoint, {first('message', P.ENDPOINT_IN_TEXT)})")} AS endpoint,
    coalesce(jstatus, CAST({first('message', P.STATUS_IN_TEXT)} AS INTEGER)) AS status_code,
    coalesce(jlevel, CASE WHEN {first('message', P.LEVEL_IN_TEXT)} = 'WARN' THEN 'WARNING'
                     ELSE {first('message', P.LEVEL_IN_TEXT)} END) AS level,
    CASE WHEN tr.event_id IS NULL THEN {first('message', P.EXCEPTION_IN_TEXT)} ELSE tr.root_type END AS exception_type,
    {_TEMPLATE} AS template
  FROM red LEFT JOIN tr ON red.event_id = tr.event_id LEFT JOIN rf ON red.event_id = rf.event_id),
enr AS (
  SELECT *, {strip('message')} = '' AS is_blank,
    contains(raw, 'ERROR') OR contains(raw, 'error') AS is_error,
    CASE WHEN chain IS NULL THEN {fingerprint('exception_type', 'template', 'endpoint', 'status_code')}
         ELSE {fingerprint('chain', 'frames', 'template')} END AS fingerprint
  FROM named)"""


def enriched(cfg: Config = DEFAULTS) -> str:
    """CTEs up to ``enr``: every log event redacted and enriched."""
    return ", ".join([LOGS, FIELDS, red_cte(cfg), TRACES, ENRICHED])


def clusters(scope: str, window_end: str, source: str = "enr WHERE is_error") -> str:
    """CTEs from ``src`` to ``ranked`` for scope columns present in ``source``."""
    s = ", ".join(f"{c}" for c in scope.split(", "))
    on = " AND ".join(f"c.{c} = m.{c}" for c in scope.split(", "))
    return f"""src AS (SELECT * FROM {source}),
vis AS (SELECT * FROM src WHERE NOT is_blank),
fpc AS (
  SELECT {s}, exception_type, template, fingerprint, count(*) AS n FROM vis
  GROUP BY {s}, exception_type, template, fingerprint),
dom AS (
  SELECT {s}, exception_type, template, max_by(fingerprint, n * 1000000 + rk) AS cluster_id
  FROM (SELECT *, row_number() OVER (PARTITION BY {s}, exception_type, template ORDER BY n, fingerprint) AS rk FROM fpc) x
  GROUP BY {s}, exception_type, template),
clu AS (
  SELECT {s}, exception_type, template, count(*) AS event_count, min(ts) AS first_seen, max(ts) AS last_seen,
    arg_min_null(level, ts) AS level, coalesce(bool_or(status_code BETWEEN 500 AND 599), false) AS has_5xx
  FROM vis GROUP BY {s}, exception_type, template),
mx AS (SELECT {s}, max(event_count) AS max_count, count(*) AS scope_clusters FROM clu GROUP BY {s}),
scored AS (
  SELECT c.*, d.cluster_id, m.max_count, m.scope_clusters,
    round(CAST(0.3 AS DOUBLE) * (CAST(c.event_count AS DOUBLE) / m.max_count)
    + CAST(0.2 AS DOUBLE) * (CASE WHEN epoch_us({window_end}) - epoch_us(last_seen) <= 300000000 THEN CAST(1 AS DOUBLE)
        ELSE greatest(CAST(0 AS DOUBLE), 1 - CAST(epoch_us({window_end}) - epoch_us(last_seen) AS DOUBLE) / 1e6 / CAST(3600 AS DOUBLE)) END)
    + CAST(0.2 AS DOUBLE) * (CASE upper(coalesce(nullif(level, ''), 'ERROR')) WHEN 'CRITICAL' THEN CAST(1 AS DOUBLE) WHEN 'FATAL' THEN CAST(1 AS DOUBLE)
        WHEN 'ERROR' THEN CAST(0.8 AS DOUBLE) WHEN 'WARNING' THEN CAST(0.4 AS DOUBLE) WHEN 'WARN' THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END)
    + (CASE WHEN has_5xx THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)
    + (CASE WHEN c.exception_type IS NOT NULL THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 4) AS score
  FROM clu c JOIN mx m ON {on}
  JOIN dom d ON {on.replace('m.', 'd.')} AND c.template = d.template AND c.exception_type IS NOT DISTINCT FROM d.exception_type),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {s} ORDER BY score DESC, event_count DESC, cluster_id, exception_type NULLS FIRST, template) AS rank
  FROM scored)"""
