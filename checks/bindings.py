"""Inputs of the registered queries, derived from the given tables.

Each is one SQL text that both engines run, so that both sides of a comparison start from the
same rows. `{name}` stands for a given table, `ROWS_OF_name` for its number of rows, which Spark
gets as a literal: as a subquery it could end up in a broadcast join's key, where it fails.
"""

from __future__ import annotations

import re
from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession

from daytrail.operators import unified
from daytrail.session import scratch_dir
from daytrail.sources import dated as tables

AS_OF = "2024-01-31 00:00:00"
DAY = "2024-01-15"
WEEK = "2024-01-15"
NOW = "2001-08-02 00:00:00"

_EPOCH_US = {
    "spark": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', timestamp)",
    "duckdb": "epoch_us(timestamp)",
}

# name: (inputs among the other bindings, SQL). Given tables need no mention.
BINDINGS: dict[str, tuple[list[str], str]] = {
    "base_events": ([], """
SELECT e.event_id AS id, e.user_id, e.event_type AS kind, e.value, e.props, e.ts AS timestamp,
  p.page_id, p.url AS page_url,
  CASE WHEN e.event_type IN ('view','click') THEN 'web' ELSE 'app' END AS type
FROM {events} e LEFT JOIN {pages} p ON p.page_id = e.event_id % ROWS_OF_pages"""),
    "usage_events": (["base_events"], """
SELECT id, type,
  CASE WHEN type = 'web' THEN 'Chrome' ELSE concat('app_', CAST(user_id % 20 AS STRING)) END AS app_name,
  CASE WHEN type = 'app' THEN concat(kind, ' - ', props) END AS window_title,
  CASE WHEN type = 'web' THEN page_url END AS url,
  CASE WHEN type = 'web' THEN concat('page ', CAST(page_id AS STRING)) END AS title,
  timestamp, CAST(floor(value) AS INT) AS duration_seconds, user_id
FROM base_events"""),
    # Text fields with every kind of fault among them.
    "raw_events": (["usage_events"], """
SELECT id,
  CASE WHEN id % 29 = 0 THEN 'app_v2' WHEN id % 31 = 0 THEN NULL ELSE type END AS type,
  CASE WHEN type = 'app' AND id % 11 = 0 THEN NULL WHEN id % 37 = 0 THEN repeat(app_name, 60) ELSE app_name END AS app_name,
  CASE WHEN id % 41 = 0 THEN repeat(window_title, 90)
       WHEN id % 7 = 0 THEN window_title || ' Password: pw' || CAST(id AS STRING) || ' user=u' || CAST(user_id AS STRING)
       ELSE window_title END AS window_title,
  CASE WHEN id % 47 = 0 THEN 'x1' ELSE CAST(user_id AS STRING) END AS process_id,
  CASE WHEN id % 13 = 0 THEN replace(url, 'http', 'ftp') WHEN id % 17 = 0 THEN NULL
       WHEN id % 5 = 0 THEN url || '?x=1&Token=abc' || CAST(id AS STRING) || '&y=a%20b&x=2'
       ELSE url END AS url,
  CASE WHEN id % 53 = 0 THEN repeat(title, 200) WHEN id % 7 = 0 THEN title || ' token=t' || CAST(id AS STRING) ELSE title END AS title,
  CASE WHEN id % 43 = 0 THEN 'yesterday' WHEN id % 6 = 0 THEN NULL ELSE CAST(timestamp AS STRING) END AS timestamp,
  CASE WHEN id % 6 = 0 THEN CAST(timestamp AS STRING) END AS visit_time,
  CASE WHEN id % 19 = 0 THEN '-5' WHEN id % 23 = 0 THEN '12.5' WHEN id % 8 = 0 THEN NULL
       WHEN id % 9 = 0 THEN concat(CAST(duration_seconds AS STRING), '.0') ELSE CAST(duration_seconds AS STRING) END AS duration_seconds,
  CASE WHEN id % 8 = 0 THEN CAST(duration_seconds AS STRING) END AS visit_duration
FROM usage_events"""),
    "url_texts": ([], """
SELECT page_id AS id, 0 AS variant, url FROM {pages}
UNION ALL
SELECT page_id AS id, 1 AS variant, concat(replace(url, '#top', ''), CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END,
  'token=abc', CAST(page_id AS STRING), '&lang=a%20b+c&&flag&My_Key=1&lang=*~', CASE WHEN page_id % 2 = 0 THEN '#s' ELSE '' END) AS url FROM {pages}
UNION ALL
SELECT page_id AS id, 2 AS variant, concat('https://user:pw@WWW.', substring(url, 9)) AS url FROM {pages}
UNION ALL
SELECT page_id AS id, 3 AS variant, concat('no url ', CAST(page_id AS STRING)) AS url FROM {pages}"""),
    "search_urls": ([], """
SELECT p_partkey AS id, CASE p_partkey % 5
  WHEN 0 THEN concat('https://www.google.com/search?hl=en&q=', replace(p_name, ' ', '+'))
  WHEN 1 THEN concat('https://www.bing.com/search?q=', replace(p_name, ' ', '%20'))
  WHEN 2 THEN concat('https://duckduckgo.com/?q=', replace(p_name, ' ', '+'), '&t=h')
  WHEN 3 THEN concat('https://www.youtube.com/results?search_query=', replace(p_name, ' ', '+'))
  ELSE concat('https://shop.example.com/search?q=', replace(p_name, ' ', '+')) END AS url FROM {part}"""),
    "titles": (["usage_events"], """
SELECT id, CASE user_id % 3 WHEN 0 THEN 'chrome' WHEN 1 THEN 'firefox' ELSE 'notepad' END AS browser,
  concat(coalesce(title, window_title), CASE user_id % 3 WHEN 0 THEN ' - Google Chrome' WHEN 1 THEN ' - Mozilla Firefox' ELSE ' - Notepad' END) AS title
FROM usage_events"""),
    "visits": (["usage_events", "base_events"], """
SELECT b.id, b.user_id, b.page_id AS url, EPOCH_US + 11644473600000000 AS visit_time,
  CAST(floor(b.value) AS BIGINT) * 1500000 AS visit_duration
FROM base_events b WHERE b.type = 'web'"""),
    "urls": ([], """
SELECT page_id AS id, url, CASE WHEN page_id % 9 = 0 THEN '   ' WHEN page_id % 10 = 0 THEN NULL
  ELSE concat('page ', CAST(page_id AS STRING)) END AS title FROM {pages}"""),
    "chromium_rows": (["visits", "urls"], """
SELECT v.id, concat('chrome:', CAST(v.user_id % 3 AS STRING)) AS source, 'chrome' AS browser,
  CASE WHEN v.id % 25 = 0 THEN 'not-a-web-url' ELSE u.url END AS url, u.title, v.visit_time
FROM visits v JOIN urls u ON u.id = v.url WHERE v.user_id % 2 = 0"""),
    "firefox_rows": (["visits", "urls"], """
SELECT v.id, concat('firefox:', CAST(v.user_id % 3 AS STRING)) AS source, 'firefox' AS browser,
  u.url, u.title, v.visit_time - 11644473600000000 AS visit_time
FROM visits v JOIN urls u ON u.id = v.url WHERE v.user_id % 2 = 1"""),
    "marks": (["chromium_rows", "firefox_rows"], """
SELECT source, CAST(floor((min(visit_time) + max(visit_time)) / 2) AS BIGINT) AS marker FROM chromium_rows
WHERE source <> 'chrome:1' GROUP BY source
UNION ALL
SELECT source, CAST(floor((min(visit_time) + max(visit_time)) / 2) AS BIGINT) AS marker FROM firefox_rows GROUP BY source"""),
    "browser_windows": (["usage_events"], """
SELECT id, user_id, 'chrome' AS browser, concat('Page ', CAST(id % 40 AS STRING), ' - Google Chrome') AS window_title, timestamp
FROM usage_events WHERE type = 'app'"""),
    "page_visits": (["usage_events"], """
SELECT id, user_id, 'chrome' AS browser, concat('page ', CAST(id % 40 AS STRING)) AS title, url, timestamp
FROM usage_events WHERE type = 'web'"""),
    "browser_sessions": (["usage_events"], """
SELECT id, user_id, 'chrome' AS browser, CASE WHEN id % 2 = 0 THEN 'chrome.exe' ELSE app_name END AS app_name, window_title,
  timestamp AS started_at, timestamp + CAST(duration_seconds * 600 AS INT) * INTERVAL '1' SECOND AS ended_at
FROM usage_events WHERE type = 'app'"""),
    "media_polls": ([], """
SELECT event_id AS id, user_id, concat('player_', CAST(user_id % 5 AS STRING)) AS source_app, event_type AS title,
  concat('artist ', CAST(user_id % 4 AS STRING)) AS artist,
  CASE WHEN value < 5 THEN 'paused' ELSE 'playing' END AS playback_state,
  CASE WHEN event_id % 7 <> 0 THEN CAST(floor(value * 100) AS BIGINT) * 100000 END AS position_ticks,
  ts AS polled_at
FROM {events}"""),
    "delivery_log": ([], """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 50 = 0 THEN '{{"type":"app"'
       ELSE concat('{{"type":"', CASE WHEN o_custkey % 3 = 0 THEN 'web' ELSE 'app' END, '","app_name":"c', CAST(o_custkey AS STRING), '"}}') END AS payload,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'pending'
       WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'processing' END AS status,
  CAST(o_custkey % 6 AS INT) AS retry_count,
  o_orderdate AS created_at, o_orderdate + CAST(o_orderkey % 30 AS INT) * INTERVAL '1' MINUTE AS updated_at,
  CASE WHEN o_custkey % 6 > 0 THEN o_orderdate + CAST(o_custkey % 400 AS INT) * INTERVAL '1' DAY END AS next_retry_at,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'load failed' END AS error_message
FROM {orders}"""),
    "app_usage": (["usage_events"], """
SELECT timestamp AS logged_at, timestamp AS started_at, timestamp + CAST(duration_seconds AS INT) * INTERVAL '1' SECOND AS ended_at,
  CAST(duration_seconds AS BIGINT) AS duration_seconds, concat(app_name, '.exe') AS process_name, app_name, window_title
FROM usage_events WHERE type = 'app'
UNION ALL
SELECT timestamp, timestamp, timestamp + CAST(duration_seconds AS INT) * INTERVAL '1' SECOND,
  CAST(duration_seconds AS BIGINT), concat(app_name, '.exe'), app_name, window_title
FROM usage_events WHERE type = 'app' AND id % 10 = 0"""),
    "website_usage": (["usage_events"], """
SELECT timestamp AS logged_at, timestamp AS started_at, timestamp + CAST(duration_seconds AS INT) * INTERVAL '1' SECOND AS ended_at,
  CAST(duration_seconds AS BIGINT) AS duration_seconds, 'chrome' AS browser,
  regexp_extract(url, '^https?://(?:www[.])?([^/?#:]+)', 1) AS domain, url, title AS page_title, 'active_window' AS source
FROM usage_events WHERE type = 'web'"""),
    "website_visits": (["usage_events", "search_urls"], """
SELECT logged_at, visited_at, browser, regexp_extract(url, '^https?://(?:www[.])?([^/?#:]+)', 1) AS domain, url, page_title, source
FROM (SELECT e.timestamp AS logged_at, e.timestamp AS visited_at, 'chrome' AS browser,
  CASE WHEN e.id % 4 = 0 THEN s.url ELSE e.url END AS url, e.title AS page_title, 'history' AS source
  FROM usage_events e JOIN search_urls s ON s.id = e.id % ROWS_OF_part WHERE e.type = 'web') v"""),
    "media_playback": ([], """
SELECT ts AS logged_at, ts AS started_at, ts + CAST(floor(value) AS INT) * INTERVAL '1' SECOND AS ended_at,
  CAST(floor(value) AS BIGINT) AS duration_seconds, concat('player_', CAST(user_id % 5 AS STRING)) AS source_app,
  concat(CASE WHEN user_id % 3 = 0 THEN 'focus ' ELSE '' END, event_type) AS title,
  concat('artist ', CAST(user_id % 4 AS STRING)) AS artist, 'playing' AS playback_state
FROM {events} WHERE event_type IN ('purchase', 'signup')"""),
    "media_track_change": ([], """
SELECT ts AS logged_at, ts AS changed_at, concat('player_', CAST(user_id % 5 AS STRING)) AS source_app, event_type AS title,
  concat('artist ', CAST(user_id % 4 AS STRING)) AS artist, 'playing' AS playback_state
FROM {events} WHERE event_type = 'error'"""),
    "rules": (["usage_events", "website_usage"], """
SELECT 'app' AS kind, app_name AS name, CASE WHEN length(app_name) = 5 THEN 'productive' ELSE 'unproductive' END AS activity
FROM usage_events WHERE type = 'app' AND user_id % 20 <> 7 GROUP BY app_name
UNION ALL
SELECT 'domain' AS kind, domain AS name, CASE WHEN domain LIKE '%.com' THEN 'productive' ELSE 'unproductive' END AS activity
FROM website_usage WHERE domain NOT LIKE '%.net' GROUP BY domain"""),
    # Typed payload rows: the fields of one event type each, as text.
    "payload_rows": (["base_events"], """
SELECT id, user_id,
  CASE id % 4 WHEN 0 THEN 'APP_USAGE' WHEN 1 THEN 'WEBSITE_USAGE' WHEN 2 THEN 'WEBSITE_VISIT' ELSE 'MEDIA_PLAYBACK' END AS event_type,
  CASE WHEN id % 4 <> 2 THEN CAST(timestamp AS STRING) END AS ended_at,
  CASE WHEN id % 4 = 2 THEN CAST(timestamp AS STRING) END AS visited_at,
  CASE WHEN id % 4 <> 2 THEN CAST(CAST(floor(value) AS INT) AS STRING) END AS duration_seconds,
  CASE WHEN id % 4 = 0 THEN concat('app_', CAST(user_id % 20 AS STRING)) END AS app_name,
  CASE WHEN id % 4 = 0 AND id % 8 <> 0 THEN concat('app_', CAST(user_id % 20 AS STRING), '.exe') END AS process_name,
  CASE WHEN id % 4 = 0 THEN concat(kind, ' - ', props) END AS window_title,
  CASE WHEN id % 4 IN (1, 2) THEN 'chrome' END AS browser,
  CASE WHEN id % 4 IN (1, 2) THEN page_url END AS url,
  CASE WHEN id % 4 IN (1, 2) THEN concat('page ', CAST(page_id AS STRING)) END AS page_title,
  CASE WHEN id % 4 = 3 THEN concat('player_', CAST(user_id % 5 AS STRING)) END AS source_app,
  CASE WHEN id % 4 = 3 THEN kind END AS title,
  CASE WHEN id % 4 = 3 THEN concat('artist ', CAST(user_id % 4 AS STRING)) END AS artist
FROM base_events"""),
    "integrity_rows": (["base_events"], """
SELECT concat('k', CAST(id - id % 20 + CASE WHEN id % 20 < 17 THEN id % 20 ELSE 0 END AS STRING)) AS event_key, timestamp,
  CAST(CASE WHEN id % 9 = 0 THEN 3 ELSE floor(hour(timestamp) / 8) + 1 END AS INT) AS shift_id,
  CASE WHEN type = 'web' THEN 'WEBSITE_VISIT' ELSE 'APP_USAGE' END AS event_type,
  CASE WHEN id % 15 = 0 THEN 'MEDIA' WHEN type = 'web' THEN 'WEB' ELSE 'APP' END AS category
FROM base_events"""),
}

GIVEN = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
         "embeddings", "pages", "benchmark", "labels", "conversations"]


def _text(name: str, engine: str) -> str:
    return BINDINGS[name][1].replace("EPOCH_US", _EPOCH_US[engine])


@cache
def _rows(spark: SparkSession, sf_dir: str, table: str) -> int:
    return given(spark, sf_dir, table).count()


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bind(spark: SparkSession, sf_dir: str, name: str, **known: DataFrame) -> DataFrame:
    """The binding as a DataFrame."""
    inputs, _ = BINDINGS[name]
    text = re.sub(r"ROWS_OF_(\w+)", lambda m: str(_rows(spark, sf_dir, m[1])), _text(name, "spark"))
    frames = {}
    for other in inputs:
        text = re.sub(rf"\b(FROM|JOIN) {other}\b", rf"\1 {{{other}}}", text)
        frames[other] = known.get(other) or bind(spark, sf_dir, other)
    for table in GIVEN:
        if f"{{{table}}}" in text:
            frames[table] = given(spark, sf_dir, table)
    return spark.sql(text, **frames)


def facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    load = partial(bind, spark, sf_dir)
    return {t: load(t) for t in
            ("app_usage", "website_visits", "website_usage", "media_playback", "media_track_change")}


@cache
def dated_path(spark: SparkSession, sf_dir: str) -> str:
    """The facts and the unified log as tables by day, written once a session."""
    path = scratch_dir(spark, "dated")
    tables.write_facts(facts(spark, sf_dir), f"{path}/facts")
    tables.write_log(unified.normalize_event(bind(spark, sf_dir, "payload_rows")), f"{path}/log")
    bind(spark, sf_dir, "rules").write.parquet(f"{path}/rules")
    return path


def dated(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The fact tables, from the tables by day."""
    return tables.read_facts(spark, f"{dated_path(spark, sf_dir)}/facts")


def dated_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activity rules, which are derived from all events, as they were stored with the facts."""
    return spark.read.parquet(f"{dated_path(spark, sf_dir)}/rules")


def dated_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_log(spark, f"{dated_path(spark, sf_dir)}/log")


def duckdb_ctes(*names: str) -> str:
    """The bindings, and those they build on, as the start of a WITH list."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in BINDINGS[name][0]:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    tables = {t: t for t in GIVEN}
    texts = {n: re.sub(r"ROWS_OF_(\w+)", r"(SELECT count(*) FROM \1)", _text(n, "duckdb")) for n in ordered}
    return ",\n".join(f"{n} AS ({t.format(**tables).strip()})" for n, t in texts.items())
