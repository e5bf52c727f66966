"""SQL pieces for DuckDB that several comparisons share."""

from __future__ import annotations

from daytrail.functions.privacy import SENSITIVE_PARAMS, SENSITIVE_TEXT

# RE2 knows ASCII word boundaries only. So each letter or digit beyond ASCII is put between two
# ASCII marks before the replacing, and the marks are taken out after it.
_MARK = "QZXQ"
_BEYOND = r"[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2AF}\x{370}-\x{1FFF}\x{2C00}-\x{2FEF}\x{3040}-\x{D7FF}\x{F900}-\x{FDFF}]"
_SPACES = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def redact_text(col: str) -> str:
    sql = rf"regexp_replace({col}, '({_BEYOND})', '{_MARK}\1{_MARK}', 'g')"
    for p in SENSITIVE_TEXT:
        p = p.replace(r"[-\s]", f"[-{_SPACES}]").replace(r"\s", f"[{_SPACES}]").replace(r"\S", f"[^{_SPACES}]")
        sql = f"regexp_replace({sql}, '{p}', '[REDACTED]', 'gi')"
    return f"replace({sql}, '{_MARK}', '')"


_URL = r"'^([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"
SENSITIVE = "|".join(SENSITIVE_PARAMS)


def _assemble(url: str, query: str) -> str:
    return (f"CASE WHEN _query <> '' THEN _base || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END"
            f" || CASE WHEN _fragment <> '' THEN '#' || _fragment ELSE '' END ELSE {url} END")


def url_parts(src: str, out: str, url: str = "url") -> str:
    return f"""{out} AS (SELECT *, regexp_extract({url}, {_URL}, 1, 's') AS _base,
  regexp_extract({url}, {_URL}, 2, 's') AS _query, regexp_extract({url}, {_URL}, 3, 's') AS _fragment,
  list_filter(string_split(regexp_extract({url}, {_URL}, 2, 's'), '&'), lambda p: p <> '') AS _pairs FROM {src})"""


def redact_url(src: str, out: str, url: str = "url") -> str:
    """CTEs that add `_redacted_url` to the columns of `src`."""
    dec = "url_decode(replace({}, '+', ' '))"
    enc = "replace(url_encode({}), '%20', '+')"
    value = "CASE WHEN contains(p, '=') THEN substr(p, instr(p, '=') + 1) ELSE '' END"
    kv = f"lambda p: {{'n': {dec.format('split_part(p, chr(61), 1)')}, 'v': {dec.format(value)}}}"
    return f"""{url_parts(src, out + '_1', url)},
{out}_2 AS (SELECT *, list_transform(_pairs, {kv}) AS _kv FROM {out}_1),
{out}_3 AS (SELECT *, list_transform(_kv, lambda x: x.n) AS _all FROM {out}_2),
{out}_4 AS (SELECT *, list_filter(_all, lambda x, i: list_position(_all, x) = i) AS _names FROM {out}_3),
{out}_5 AS (SELECT *, array_to_string(list_transform(_names, lambda m:
    CASE WHEN regexp_matches(lower(m), '{SENSITIVE}') THEN 'redacted=%5BREDACTED%5D'
    ELSE array_to_string(list_transform(list_filter(_kv, lambda x: x.n = m), lambda x: {enc.format('x.n')} || '=' || {enc.format('x.v')}), '&') END), '&') AS _rebuilt
  FROM {out}_4),
{out} AS (SELECT *, {_assemble(url, '_rebuilt')} AS _redacted_url FROM {out}_5)"""


def drop_params(src: str, out: str, url: str = "url") -> str:
    """CTEs that add `_kept_url` to the columns of `src`."""
    return f"""{url_parts(src, out + '_1', url)},
{out}_2 AS (SELECT *, array_to_string(list_filter(_pairs, lambda p: NOT regexp_matches(lower(split_part(p, '=', 1)), '{SENSITIVE}')), '&') AS _rebuilt FROM {out}_1),
{out} AS (SELECT *, {_assemble(url, '_rebuilt')} AS _kept_url FROM {out}_2)"""


def domain(url: str) -> str:
    pattern = r"'^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(?:[Ww][Ww][Ww]\.)?(\[[^\]]*\]|[^/?#:\[]+)'"
    return f"nullif(lower(regexp_extract({url}, {pattern}, 1)), '')"


def micros(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"


def whole(text: str) -> str:
    return rf"try_cast(nullif(regexp_extract(trim({text}), '^([+-]?[0-9]+)(?:\.0*)?$', 1), '') AS BIGINT)"


# Raw events with browser aliases filled in, and the rules each breaks.
NORMALIZED = """normalized AS (SELECT id, type, app_name, window_title, process_id, url, title,
  CASE WHEN type = 'web' THEN coalesce(timestamp, visit_time) ELSE timestamp END AS timestamp,
  CASE WHEN type = 'web' THEN coalesce(duration_seconds, visit_duration) ELSE duration_seconds END AS duration_seconds
FROM raw_events)"""
VALIDATED = NORMALIZED + f""",
validated AS (SELECT *, array_to_string(list_filter([
  CASE WHEN type IS NULL OR type NOT IN ('app', 'web') THEN 'type_unknown' END,
  CASE WHEN type = 'app' AND app_name IS NULL THEN 'app_name_missing' END,
  CASE WHEN type = 'app' AND length(app_name) > 255 THEN 'app_name_too_long' END,
  CASE WHEN type = 'app' AND length(window_title) > 1000 THEN 'window_title_too_long' END,
  CASE WHEN type = 'app' AND process_id IS NOT NULL AND {whole('process_id')} IS NULL THEN 'process_id_invalid' END,
  CASE WHEN type = 'web' AND url IS NULL THEN 'url_missing' END,
  CASE WHEN type = 'web' AND length(url) > 2000 THEN 'url_too_long' END,
  CASE WHEN type = 'web' AND NOT (url LIKE 'http://%' OR url LIKE 'https://%') THEN 'url_scheme' END,
  CASE WHEN type = 'web' AND length(title) > 1000 THEN 'title_too_long' END,
  CASE WHEN duration_seconds IS NOT NULL AND NOT coalesce({whole('duration_seconds')} BETWEEN 0 AND 86400, false) THEN 'duration_invalid' END,
  CASE WHEN try_cast(timestamp AS TIMESTAMP) IS NULL THEN 'timestamp_invalid' END
], lambda r: r IS NOT NULL), ',') AS reasons FROM normalized)"""
LOADABLE = VALIDATED + f""",
{redact_url("(SELECT * FROM validated WHERE reasons = '')", 'redacted')},
loadable AS (SELECT id, type,
  CASE WHEN type = 'web' THEN 'Chrome' ELSE coalesce(app_name, 'Unknown') END AS app_name,
  CASE WHEN type = 'app' THEN coalesce({redact_text('window_title')}, '') END AS window_title,
  CASE WHEN type = 'web' THEN coalesce(_redacted_url, '') END AS url,
  CASE WHEN type = 'web' THEN coalesce({redact_text('title')}, '') END AS title,
  CAST(timestamp AS TIMESTAMP) AS timestamp,
  CAST(coalesce({whole('duration_seconds')}, 0) AS INT) AS duration_seconds
FROM redacted)"""


def usage_key() -> str:
    return (f"md5(concat_ws(chr(31), {micros('timestamp')}, coalesce(type, ''), coalesce(app_name, ''), coalesce(window_title, ''),"
            " coalesce(url, ''), coalesce(title, ''), coalesce(CAST(duration_seconds AS VARCHAR), '')))")


def unified_key(second: bool = False) -> str:
    moment = "strftime(timestamp, '%Y-%m-%d %H:%M:%S')" if second else micros("timestamp")
    fields = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in ("event_type", "item", "\"window\"", "url", "duration_seconds"))
    return f"md5(concat_ws(chr(31), {moment}, {fields}))"


# Unified rows of the payload binding.
UNIFIED = f"""unified_base AS (SELECT id, user_id,
  CAST(coalesce(ended_at, visited_at) AS TIMESTAMP) AS timestamp,
  CASE WHEN event_type LIKE 'APP%' THEN 'APP' WHEN event_type LIKE 'WEB%' THEN 'WEB' ELSE 'MEDIA' END AS category,
  CASE WHEN event_type LIKE 'APP%' THEN coalesce(process_name, app_name) WHEN event_type LIKE 'WEB%' THEN browser ELSE source_app END AS source,
  CASE WHEN event_type LIKE 'APP%' THEN app_name WHEN event_type LIKE 'WEB%' THEN {domain('url')} ELSE title || ' - ' || artist END AS item,
  event_type, CAST(coalesce(duration_seconds, '0') AS BIGINT) AS duration_seconds,
  CASE WHEN event_type LIKE 'APP%' THEN window_title WHEN event_type LIKE 'WEB%' THEN page_title ELSE title END AS "window", url
FROM payload_rows),
unified AS (SELECT *, CAST(hour(timestamp) // 8 + 1 AS INT) AS shift_id, {unified_key()} AS event_key FROM unified_base)"""

READABLE = ("CASE WHEN duration_seconds >= 3600 THEN (duration_seconds // 3600) || 'h ' ELSE '' END"
            " || CASE WHEN duration_seconds >= 60 THEN (duration_seconds % 3600 // 60) || 'm ' ELSE '' END"
            " || (duration_seconds % 60) || 's'")


def one_day(ts: str, day: str) -> str:
    return f"CAST({ts} AS DATE) = DATE '{day}'"
