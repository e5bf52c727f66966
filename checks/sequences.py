"""Row order, sessions, history joins and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import duck
from checks.bindings import bind
from checks.registry import query
from daytrail.operators import joins, sequence

UE = ("usage_events",)
_BY_USER = "PARTITION BY user_id ORDER BY timestamp, id"
_SAME = "app_name IS NOT DISTINCT FROM prev_app AND window_title IS NOT DISTINCT FROM prev_title"
_LAGGED = f"""lagged AS (SELECT *, lag(id) OVER w AS prev_id, lag(app_name) OVER w AS prev_app,
  lag(window_title) OVER w AS prev_title, lag(timestamp) OVER w AS prev_ts FROM usage_events WINDOW w AS ({_BY_USER}))"""


@query("changed_only", needs=UE, ctes=_LAGGED,
       sql=f"SELECT id FROM lagged WHERE NOT (prev_id IS NOT NULL AND {_SAME} AND epoch_us(timestamp) - epoch_us(prev_ts) <= 43200000000)")
def _(spark, sf):
    return sequence.changed_only(bind(spark, sf, "usage_events"), max_gap_seconds=43200).select("id")


@query("dedupe_events", needs=UE, sql="""
SELECT id FROM usage_events QUALIFY row_number() OVER (
  PARTITION BY type, app_name, window_title, CASE WHEN type = 'web' THEN url END ORDER BY timestamp, id) = 1""")
def _(spark, sf):
    return sequence.dedupe_events(
        bind(spark, sf, "usage_events"), sequence.event_signature(), ["timestamp", "id"]).select("id")


@query("sessionize", needs=UE, ctes=_LAGGED + f""",
marked AS (SELECT *, CASE WHEN prev_id IS NOT NULL AND app_name IS NOT DISTINCT FROM prev_app
    AND epoch_us(timestamp) - epoch_us(prev_ts) <= 43200000000 THEN 0 ELSE 1 END AS brk FROM lagged),
numbered AS (SELECT *, sum(brk) OVER ({_BY_USER}) AS run FROM marked)""", sql="""
SELECT user_id, any_value(app_name) AS app_name, min(timestamp) AS started_at, max(timestamp) AS ended_at,
  count(*) AS n_events, CAST(sum(duration_seconds) AS BIGINT) AS duration_seconds FROM numbered GROUP BY user_id, run""")
def _(spark, sf):
    return sequence.sessionize(bind(spark, sf, "usage_events"), 43200, same=("app_name",))


_SESSION_URL = """found AS (SELECT s.*, (SELECT v.url FROM page_visits v WHERE v.user_id = s.user_id
    AND v.timestamp >= s.started_at AND v.timestamp <= s.ended_at ORDER BY v.timestamp DESC, v.id DESC LIMIT 1) AS visited
  FROM browser_sessions s)"""


@query("usage_spans", needs=("browser_sessions", "page_visits"), ctes=_SESSION_URL, sql=f"""
SELECT 'app_usage' AS fact, user_id, app_name, window_title, started_at, ended_at,
  CAST((epoch_us(ended_at) - epoch_us(started_at)) // 1000000 AS BIGINT) AS duration_seconds, NULL AS url, NULL AS domain FROM found
UNION ALL SELECT 'website_usage', user_id, app_name, window_title, started_at, ended_at,
  CAST((epoch_us(ended_at) - epoch_us(started_at)) // 1000000 AS BIGINT), visited, {duck.domain('visited')} FROM found
WHERE app_name = 'chrome.exe' AND visited IS NOT NULL""")
def _(spark, sf):
    return sequence.usage_spans(bind(spark, sf, "browser_sessions"), bind(spark, sf, "page_visits"))


_BY_PLAYER = "PARTITION BY user_id, source_app ORDER BY polled_at, id"


@query("media_sessions", needs=("media_polls",), ctes=f"""
near AS (SELECT *, lead(id) OVER w AS n_id, lead(title) OVER w AS n_title, lead(artist) OVER w AS n_artist,
  lead(position_ticks) OVER w AS n_ticks, epoch_us(lead(polled_at) OVER w) - epoch_us(polled_at) AS clock,
  lag(id) OVER w AS p_id, lag(title) OVER w AS p_title, lag(artist) OVER w AS p_artist, lag(playback_state) OVER w AS p_state
  FROM media_polls WINDOW w AS ({_BY_PLAYER})),
timed AS (SELECT *, CASE WHEN n_id IS NULL THEN 0
    WHEN title = n_title AND artist = n_artist AND (n_ticks - position_ticks) // 10 BETWEEN 0 AND clock + 5000000 THEN (n_ticks - position_ticks) // 10
    ELSE clock END AS played,
  CASE WHEN p_id IS NOT NULL AND title = p_title AND artist = p_artist AND playback_state = p_state THEN 0 ELSE 1 END AS brk FROM near),
numbered AS (SELECT *, sum(brk) OVER ({_BY_PLAYER}) AS run FROM timed)""", sql="""
SELECT user_id, source_app, any_value(title) AS title, any_value(artist) AS artist, min(polled_at) AS started_at, max(polled_at) AS last_seen,
  count(*) AS n_events, CAST(sum(played) AS BIGINT) / 1e6 AS duration_seconds
FROM numbered WHERE playback_state = 'playing' GROUP BY user_id, source_app, run""")
def _(spark, sf):
    return sequence.media_sessions(bind(spark, sf, "media_polls"))


@query("track_changes", needs=("media_polls",), sql=f"""
SELECT id, title, artist FROM media_polls WINDOW w AS ({_BY_PLAYER})
QUALIFY lag(id) OVER w IS NULL OR title <> lag(title) OVER w OR artist <> lag(artist) OVER w""")
def _(spark, sf):
    return sequence.track_changes(bind(spark, sf, "media_polls")).select("id", "title", "artist")


@query("derive_durations", needs=UE, sql=f"""
SELECT id, CAST(CASE WHEN duration_seconds > 0 THEN duration_seconds
  ELSE least(coalesce((epoch_us(lead(timestamp) OVER ({_BY_USER})) - epoch_us(timestamp)) // 1000000, 0), 86400) END AS INT) AS duration_seconds
FROM (SELECT * REPLACE (CASE WHEN type = 'app' THEN NULL ELSE duration_seconds END AS duration_seconds) FROM usage_events)""")
def _(spark, sf):
    events = bind(spark, sf, "usage_events").withColumn(
        "duration_seconds", F.when(F.col("type") == "web", F.col("duration_seconds")))
    return sequence.derive_durations(events).select("id", "duration_seconds")


@query("high_watermark", needs=("chromium_rows",), sql="""
SELECT source, make_timestamp(max(visit_time) - 11644473600000000) AS watermark FROM chromium_rows GROUP BY source""")
def _(spark, sf):
    from daytrail.functions.timeparts import chromium_ts

    rows = bind(spark, sf, "chromium_rows").withColumn("timestamp", chromium_ts(F.col("visit_time")))
    return sequence.high_watermark(rows)


# Joins

_SINCE = 13_349_318_400_000_000  # 2024-01-10 in Chromium time


@query("browser_history", needs=("visits", "urls"), sql=f"""
SELECT v.id, v.user_id, 'web' AS type, u.url, u.title, make_timestamp(v.visit_time - 11644473600000000) AS timestamp,
  v.visit_duration // 1000000 AS duration_seconds
FROM visits v JOIN urls u ON u.id = v.url WHERE v.visit_time > {_SINCE} AND trim(u.title) <> ''""")
def _(spark, sf):
    return joins.browser_history(bind(spark, sf, "visits"), bind(spark, sf, "urls"), _SINCE)


@query("poll_browsers", needs=("marks",), sql=f"""
SELECT c.source, browser, {duck.domain('url')} AS domain, url, title AS page_title, make_timestamp(visit_time - 11644473600000000) AS visited_at
FROM chromium_rows c LEFT JOIN marks m ON m.source = c.source WHERE visit_time > coalesce(marker, 0) AND url LIKE 'http%'
UNION ALL SELECT f.source, browser, {duck.domain('url')}, url, title, make_timestamp(visit_time)
FROM firefox_rows f LEFT JOIN marks m ON m.source = f.source WHERE visit_time > coalesce(marker, 0) AND url LIKE 'http%'""")
def _(spark, sf):
    return joins.poll_browsers(
        bind(spark, sf, "chromium_rows"), bind(spark, sf, "firefox_rows"), bind(spark, sf, "marks"))


@query("infer_active_url", needs=("browser_windows", "page_visits"), ctes="""
matched AS (SELECT w.*, v.url AS v_url, v.timestamp AS v_ts FROM browser_windows w ASOF LEFT JOIN
  (SELECT user_id, title, timestamp, arg_max(url, id) AS url FROM page_visits GROUP BY ALL) v
  ON w.user_id = v.user_id AND replace(lower(w.window_title), ' - google chrome', '') = v.title AND w.timestamp >= v.timestamp)""",
       sql="""
SELECT id, user_id, browser, window_title, timestamp,
  CASE WHEN epoch_us(timestamp) - epoch_us(v_ts) <= 864000000000 THEN v_url END AS url FROM matched""")
def _(spark, sf):
    return joins.infer_active_url(bind(spark, sf, "browser_windows"), bind(spark, sf, "page_visits"), 864000)


@query("infer_session_url", needs=("browser_sessions", "page_visits"), ctes=_SESSION_URL, sql="SELECT id, visited AS url FROM found")
def _(spark, sf):
    return joins.infer_session_url(bind(spark, sf, "browser_sessions"), bind(spark, sf, "page_visits")).select("id", "url")


def _stores(spark, sf):
    """Two copies of the events; one lost the short rows, the other the long ones."""
    events = bind(spark, sf, "usage_events").withColumn("event_key", F.md5(F.concat_ws("|", "user_id", "timestamp")))
    return events.where("duration_seconds >= 3"), events.where("duration_seconds <= 60")


@query("reconcile", needs=UE, ctes="""
keyed AS (SELECT id, duration_seconds, md5(concat_ws('|', user_id, CAST(timestamp AS VARCHAR))) AS event_key FROM usage_events),
a AS (SELECT event_key FROM keyed WHERE duration_seconds >= 3), b AS (SELECT event_key FROM keyed WHERE duration_seconds <= 60)""", sql="""
(SELECT event_key, 'b' AS missing_from FROM a EXCEPT SELECT event_key, 'b' FROM b)
UNION ALL (SELECT event_key, 'a' FROM b EXCEPT SELECT event_key, 'a' FROM a)""")
def _(spark, sf):
    return joins.reconcile(*_stores(spark, sf))


@query("missing_rows", needs=UE, sql="SELECT id FROM usage_events WHERE duration_seconds < 3")
def _(spark, sf):
    have, other = _stores(spark, sf)
    return joins.missing_rows(have, other).select("id")
