"""Filters, reports, exports and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import duck
from checks.bindings import AS_OF, DAY, WEEK, bind, dated, dated_rules, given
from checks.clean import loaded_table
from checks.registry import query
from daytrail.operators import filters, lifecycle, unified
from daytrail.plans import daily
from daytrail.plans import reports as plans
from daytrail.session import scratch_dir
from daytrail.functions.timeparts import timestamp_lit
from daytrail.sources import dated as dated_tables
from daytrail.sources import files, lines, tables

UE = ("usage_events",)


# Filters

@query("by_type", needs=UE, sql="SELECT id, url FROM usage_events WHERE type = 'web'")
def _(spark, sf):
    return filters.by_type(bind(spark, sf, "usage_events"), "web").select("id", "url")


@query("within_days", needs=UE, sql="""
SELECT id, 'from' AS bound FROM usage_events WHERE timestamp >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY
UNION ALL SELECT id, 'after' FROM usage_events WHERE timestamp > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY""")
def _(spark, sf):
    e = bind(spark, sf, "usage_events")
    return filters.within_days(e, AS_OF, 7).select("id", F.lit("from").alias("bound")).unionByName(
        filters.within_days(e, AS_OF, 20, inclusive=False).select("id", F.lit("after").alias("bound")))


@query("since_watermark", needs=UE, sql="SELECT id FROM usage_events WHERE timestamp > TIMESTAMP '2024-01-10 06:30:00'")
def _(spark, sf):
    return filters.since_watermark(bind(spark, sf, "usage_events"), "2024-01-10 06:30:00").select("id")


@query("drop_blank_titles", needs=("urls",), sql="SELECT id, title FROM urls WHERE trim(title) <> ''")
def _(spark, sf):
    return filters.drop_blank_titles(bind(spark, sf, "urls")).select("id", "title")


@query("on_date", needs=UE, sql=f"SELECT id FROM usage_events WHERE {duck.one_day('timestamp', DAY)}")
def _(spark, sf):
    return filters.on_date(bind(spark, sf, "usage_events"), DAY).select("id")


@query("in_week", needs=UE, sql="""
SELECT id FROM usage_events WHERE CAST(timestamp AS DATE) BETWEEN DATE '2024-01-15' AND DATE '2024-01-21'""")
def _(spark, sf):
    return filters.in_week(bind(spark, sf, "usage_events"), WEEK).select("id")


@query("complete_days", needs=UE, sql="SELECT id FROM usage_events WHERE CAST(timestamp AS DATE) < DATE '2024-01-20'")
def _(spark, sf):
    return filters.complete_days(bind(spark, sf, "usage_events"), "2024-01-20 15:00:00").select("id")


# Warehouse reports

@query("app_usage_stats", needs=UE, sql="""
SELECT app_name, count(*) AS session_count, CAST(sum(duration_seconds) AS BIGINT) AS total_seconds,
  CAST(sum(duration_seconds) // count(*) AS BIGINT) AS avg_seconds, min(timestamp) AS first_seen, max(timestamp) AS last_seen
FROM usage_events WHERE type = 'app' AND timestamp >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY app_name""")
def _(spark, sf):
    return plans.app_usage_stats(bind(spark, sf, "usage_events"), AS_OF)


@query("top_websites", needs=UE, sql="""
SELECT url, count(*) AS visit_count, CAST(sum(duration_seconds) AS BIGINT) AS total_seconds, max(timestamp) AS last_visit
FROM usage_events WHERE type = 'web' AND timestamp >= TIMESTAMP '2024-01-24 00:00:00'
GROUP BY url ORDER BY visit_count DESC, url LIMIT 20""")
def _(spark, sf):
    return plans.top_websites(bind(spark, sf, "usage_events"), AS_OF)


@query("daily_summary", needs=UE, sql="""
SELECT CAST(timestamp AS DATE) AS date, type, count(*) AS event_count,
  count(DISTINCT app_name) AS unique_apps, count(DISTINCT url) AS unique_urls
FROM usage_events WHERE timestamp >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1, 2""")
def _(spark, sf):
    return plans.daily_summary(bind(spark, sf, "usage_events"), AS_OF)


@query("event_stats", needs=UE, sql="""
SELECT count(*) AS total_events, count(*) FILTER (type = 'app') AS app_events, count(*) FILTER (type = 'web') AS web_events,
  min(timestamp) AS oldest_event, max(timestamp) AS newest_event FROM usage_events""")
def _(spark, sf):
    return plans.event_stats(bind(spark, sf, "usage_events"))


@query("latency_stats", sql="""
SELECT event_type AS group_key, count(*) AS operations,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS total_seconds,
  count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS per_second,
  CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DOUBLE) / count(*) AS avg_value,
  list_sort(list(value))[CAST(floor(count(*) * 0.5::DOUBLE) AS BIGINT) + 1] AS p50,
  list_sort(list(value))[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95,
  list_sort(list(value))[CAST(floor(count(*) * 0.99::DOUBLE) AS BIGINT) + 1] AS p99,
  max(value) AS max_value, count(*) FILTER (props LIKE '%5}') AS error_count
FROM events GROUP BY event_type""")
def _(spark, sf):
    e = given(spark, sf, "events").withColumn("is_error", F.col("props").endswith("5}"))
    return plans.latency_stats(e, "value", "ts", by="event_type", error="is_error")


_TOP_USERS = """
SELECT user_id, count(*) AS events FROM usage_events GROUP BY user_id ORDER BY events DESC, user_id LIMIT 20"""


@query("top_n", needs=UE, sql=_TOP_USERS)
def _(spark, sf):
    per_user = bind(spark, sf, "usage_events").groupBy("user_id").agg(F.count("*").alias("events"))
    return filters.top_n(per_user, 20, F.col("events").desc(), F.col("user_id"))


@query("newest_first", needs=UE, sql="SELECT id, timestamp FROM usage_events")
def _(spark, sf):
    return filters.newest_first(bind(spark, sf, "usage_events")).select("id", "timestamp")


@query("recent_urls", needs=UE, sql="""
SELECT url AS id, url, max(timestamp) AS last_visit_time, count(*) AS visit_count FROM usage_events WHERE type = 'web'
GROUP BY url HAVING max(timestamp) > TIMESTAMP '2024-01-10 00:00:00' ORDER BY last_visit_time DESC, id LIMIT 100""")
def _(spark, sf):
    from daytrail.operators.joins import recent_urls

    urls = filters.by_type(bind(spark, sf, "usage_events"), "web").groupBy("url").agg(
        F.max("timestamp").alias("last_visit_time"), F.count("*").alias("visit_count"))
    return recent_urls(urls.withColumn("id", F.col("url")), "2024-01-10 00:00:00")


# Exports

def _safe(col: str) -> str:
    return f"CASE WHEN left({col}, 1) IN ('=', '+', '-', '@') THEN '''' || {col} ELSE {col} END"


def _export_sql(kind: str) -> str:
    columns = ", ".join(f"{_safe(c)} AS {c}" if c in plans.ESCAPED_COLUMNS[kind] else c
                        for c in plans.EXPORT_COLUMNS[kind] if c not in ("id", "timestamp", "duration_seconds"))
    return f"""
SELECT CAST(id AS VARCHAR) AS id, {columns},
  CASE WHEN microsecond(timestamp) % 1000000 = 0 THEN strftime(timestamp, '%Y-%m-%d %H:%M:%S') ELSE {duck.micros('timestamp')} END AS timestamp,
  CAST(duration_seconds AS VARCHAR) AS duration_seconds
FROM usage_events WHERE type = '{kind}' AND timestamp > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 25 DAY"""


def _export(kind: str):
    def run(spark, sf):
        out = scratch_dir(spark, "export")
        files.export_usage_csv(bind(spark, sf, "usage_events"), kind, AS_OF, out, retention_days=25)
        return spark.read.options(**files.CSV).schema(
            ", ".join(f"{c} STRING" for c in plans.EXPORT_COLUMNS[kind])).csv(
            f"{out}/{kind}_usage/export_date=2024-01-31")

    return run


for _kind in ("app", "web"):
    query(f"export_usage_csv_{_kind}", needs=UE, sql=_export_sql(_kind))(_export(_kind))


# Fact tables

FACTS = ("app_usage", "website_usage", "website_visits", "media_playback", "rules")
_DAY_APPS = f"day_apps AS (SELECT DISTINCT * FROM app_usage WHERE {duck.one_day('started_at', DAY)})"
_DAY_SITES = f"day_sites AS (SELECT DISTINCT * FROM website_usage WHERE {duck.one_day('started_at', DAY)})"
_DAY_MEDIA = f"day_media AS (SELECT DISTINCT * FROM media_playback WHERE {duck.one_day('started_at', DAY)})"


@query("app_time", needs=("app_usage",), ctes=_DAY_APPS,
       sql="SELECT app_name, CAST(sum(duration_seconds) AS BIGINT) AS total_seconds FROM day_apps GROUP BY app_name")
def _(spark, sf):
    return daily.app_time(dated(spark, sf)["app_usage"], DAY)


@query("count_app_sessions", needs=("app_usage",), ctes=_DAY_APPS, sql="""
SELECT count(*) AS sessions FROM (SELECT DISTINCT started_at, ended_at, duration_seconds, process_name, app_name, window_title FROM day_apps)""")
def _(spark, sf):
    return daily.count_app_sessions(dated(spark, sf)["app_usage"], DAY)


@query("website_time", needs=("website_usage",), ctes=_DAY_SITES,
       sql="SELECT domain, CAST(sum(duration_seconds) AS BIGINT) AS total_seconds FROM day_sites GROUP BY domain")
def _(spark, sf):
    return daily.website_time(dated(spark, sf)["website_usage"], DAY)


@query("website_details", needs=("website_visits",), sql=f"""
SELECT domain, url, count(*) AS visits FROM website_visits WHERE {duck.one_day('visited_at', DAY)} GROUP BY domain, url""")
def _(spark, sf):
    return daily.website_details(dated(spark, sf)["website_visits"], DAY)


@query("media_time", needs=("media_playback",), ctes=_DAY_MEDIA, sql="""
SELECT title, artist, source_app, CAST(sum(duration_seconds) AS BIGINT) AS total_seconds FROM day_media GROUP BY 1, 2, 3""")
def _(spark, sf):
    return daily.media_time(dated(spark, sf)["media_playback"], DAY)


_SEARCHES = f"""searches AS (SELECT url_decode(replace(regexp_extract(url, '[?&](?:q|search_query)=([^&#]*)', 1), '+', ' ')) AS search_query, count(*) AS visits
FROM website_visits WHERE {duck.one_day('visited_at', DAY)} AND url NOT LIKE '%shop.example%' AND regexp_matches(url, '[?&](q|search_query)=.')
GROUP BY 1)"""


@query("daily_searches", needs=("website_visits",), ctes=_SEARCHES, sql="SELECT * FROM searches")
def _(spark, sf):
    return daily.daily_searches(dated(spark, sf)["website_visits"], DAY)


_NAMED = f"""{_DAY_APPS}, {_DAY_SITES}, {_DAY_MEDIA},
named AS (
  SELECT 'app' AS kind, app_name AS name, CAST(sum(duration_seconds) AS BIGINT) AS total_seconds FROM day_apps GROUP BY app_name
  UNION ALL SELECT 'domain', domain, CAST(sum(duration_seconds) AS BIGINT) FROM day_sites GROUP BY domain
  UNION ALL SELECT 'media', title || ' - ' || artist, CAST(sum(duration_seconds) AS BIGINT) FROM day_media GROUP BY 2),
classed AS (SELECT n.*, coalesce(r.activity, CASE WHEN n.kind = 'media' AND n.name LIKE '%focus%' THEN 'productive' END, 'neutral') AS activity
  FROM named n LEFT JOIN rules r ON r.kind = n.kind AND r.name = n.name),
score AS (SELECT
  CAST(coalesce(sum(total_seconds) FILTER (activity = 'productive'), 0) AS BIGINT) AS productive_seconds,
  CAST(coalesce(sum(total_seconds) FILTER (activity = 'neutral'), 0) AS BIGINT) AS neutral_seconds,
  CAST(coalesce(sum(total_seconds) FILTER (activity = 'unproductive'), 0) AS BIGINT) AS unproductive_seconds,
  CAST(coalesce(sum(total_seconds), 0) AS BIGINT) AS total_seconds FROM classed)"""


@query("classify_activity", needs=FACTS, ctes=_NAMED, sql="SELECT kind, name, total_seconds, activity FROM classed")
def _(spark, sf):
    return daily.classify_activity(daily.activity_time(dated(spark, sf), DAY), dated_rules(spark, sf))


@query("productivity_score", needs=FACTS, ctes=f"{_NAMED}, {_SEARCHES}", sql="""
SELECT *, coalesce(100.0::DOUBLE * productive_seconds / nullif(total_seconds, 0), 0) AS score, (SELECT count(*) FROM searches) AS searches FROM score""")
def _(spark, sf):
    return daily.productivity_score(dated(spark, sf), DAY, dated_rules(spark, sf))


@query("productivity_insights", needs=FACTS, ctes=_NAMED, sql="""
(SELECT 'top_app' AS insight, name AS subject, CAST(total_seconds AS DOUBLE) AS value FROM named WHERE kind = 'app' ORDER BY total_seconds DESC, name LIMIT 1)
UNION ALL (SELECT 'top_site', name, CAST(total_seconds AS DOUBLE) FROM named WHERE kind = 'domain' ORDER BY total_seconds DESC, name LIMIT 1)
UNION ALL SELECT 'distraction_share', NULL, coalesce(100.0::DOUBLE * unproductive_seconds / nullif(total_seconds, 0), 0) FROM score
UNION ALL SELECT 'mean_session_seconds', NULL, coalesce(CAST(sum(duration_seconds) AS DOUBLE) / nullif(count(*), 0), 0) FROM day_apps""")
def _(spark, sf):
    return daily.productivity_insights(dated(spark, sf), DAY, dated_rules(spark, sf))


_IN_WEEK = "CAST(started_at AS DATE) BETWEEN DATE '2024-01-15' AND DATE '2024-01-21'"
_WEEK = f"""week_apps AS (SELECT app_name, CAST(sum(duration_seconds) AS BIGINT) AS total_seconds FROM (SELECT DISTINCT * FROM app_usage) WHERE {_IN_WEEK} GROUP BY 1),
week_sites AS (SELECT domain, CAST(sum(duration_seconds) AS BIGINT) AS total_seconds FROM (SELECT DISTINCT * FROM website_usage) WHERE {_IN_WEEK} GROUP BY 1),
week_media AS (SELECT source_app || ' | ' || title || ' - ' || artist AS track, CAST(sum(duration_seconds) AS BIGINT) AS total_seconds
  FROM (SELECT DISTINCT * FROM media_playback) WHERE {_IN_WEEK} GROUP BY 1)"""


@query("weekly_apps", needs=FACTS, ctes=_WEEK, sql="SELECT * FROM week_apps")
def _(spark, sf):
    return daily.weekly_apps(dated(spark, sf)["app_usage"], WEEK)


@query("weekly_websites", needs=FACTS, ctes=_WEEK, sql="SELECT * FROM week_sites")
def _(spark, sf):
    return daily.weekly_websites(dated(spark, sf)["website_usage"], WEEK)


@query("weekly_media", needs=FACTS, ctes=_WEEK, sql="SELECT * FROM week_media")
def _(spark, sf):
    return daily.weekly_media(dated(spark, sf)["media_playback"], WEEK)


@query("weekly_total", needs=FACTS, ctes=_WEEK, sql="SELECT CAST(sum(total_seconds) AS BIGINT) AS total_seconds FROM week_apps")
def _(spark, sf):
    return daily.weekly_total(dated(spark, sf)["app_usage"], WEEK)


@query("weekly_report", needs=FACTS, ctes=_WEEK + """,
week_named AS (SELECT 'app' AS kind, app_name AS name, total_seconds FROM week_apps
  UNION ALL SELECT 'domain', domain, total_seconds FROM week_sites
  UNION ALL SELECT 'media', title || ' - ' || artist, CAST(sum(duration_seconds) AS BIGINT)
  FROM (SELECT DISTINCT * FROM media_playback) WHERE CAST(started_at AS DATE) BETWEEN DATE '2024-01-15' AND DATE '2024-01-21' GROUP BY 2),
week_rules AS (SELECT * FROM rules UNION ALL SELECT 'media', 'purchase - artist 1', 'unproductive'),
week_classed AS (SELECT n.*, coalesce(r.activity, CASE WHEN n.kind = 'media' AND n.name LIKE '%focus%' THEN 'productive' END, 'neutral') AS activity
  FROM week_named n LEFT JOIN week_rules r ON r.kind = n.kind AND r.name = n.name)""", sql=f"""
SELECT 'app_seconds' AS metric, app_name AS key, CAST(total_seconds AS DOUBLE) AS value FROM week_apps
UNION ALL SELECT 'website_seconds', domain, CAST(total_seconds AS DOUBLE) FROM week_sites
UNION ALL SELECT 'media_seconds', track, CAST(total_seconds AS DOUBLE) FROM week_media
UNION ALL SELECT 'day_seconds', CAST(CAST(started_at AS DATE) AS VARCHAR), CAST(sum(duration_seconds) AS DOUBLE) FROM (SELECT DISTINCT * FROM app_usage) WHERE {_IN_WEEK} GROUP BY 2
UNION ALL SELECT 'day_seconds', 'total', CAST(sum(duration_seconds) AS DOUBLE) FROM (SELECT DISTINCT * FROM app_usage) WHERE {_IN_WEEK}
UNION ALL SELECT 'productivity_score', NULL,
  100.0::DOUBLE * CAST(sum(total_seconds) FILTER (activity = 'productive') AS BIGINT) / CAST(sum(total_seconds) AS BIGINT) FROM week_classed""")
def _(spark, sf):
    one_track = spark.createDataFrame([("media", "purchase - artist 1", "unproductive")], "kind STRING, name STRING, activity STRING")
    return daily.weekly_report(dated(spark, sf), WEEK, dated_rules(spark, sf).unionByName(one_track))


@query("weekly_update_day", needs=UE, sql="""
SELECT CAST(sum(duration_seconds) AS DOUBLE) / 3600 AS friday_hours,
  CASE WHEN sum(duration_seconds) / 3600.0 >= 20 THEN 4 ELSE 5 END AS update_day
FROM usage_events WHERE CAST(timestamp AS DATE) = DATE '2024-01-19'""")
def _(spark, sf):
    return daily.weekly_update_day(bind(spark, sf, "usage_events"), WEEK)


@query("first_event_date", needs=UE, sql="SELECT CAST(min(timestamp) AS DATE) AS first_date FROM usage_events")
def _(spark, sf):
    return daily.first_event_date(bind(spark, sf, "usage_events"))


@query("volume_check", sql="""
SELECT CAST(sum(strlen(o_orderpriority || ',' || o_orderkey) + 1) AS BIGINT) AS bytes,
  sum(strlen(o_orderpriority || ',' || o_orderkey) + 1) >= 200000 AS enough FROM orders""")
def _(spark, sf):
    path = scratch_dir(spark, "volume")
    given(spark, sf, "orders").select(F.concat_ws(",", "o_orderpriority", "o_orderkey")).write.text(path)
    return daily.volume_check(lines.list_files(spark, path, "*.txt"), 200_000)


@query("source_inventory", needs=("payload_rows",), sql="""
SELECT lower(event_type) AS source, 1::BIGINT AS files, count(*) AS lines FROM payload_rows GROUP BY 1""")
def _(spark, sf):
    path = scratch_dir(spark, "inventory")
    rows = unified.normalize_event(bind(spark, sf, "payload_rows"))
    for kind in ("APP_USAGE", "WEBSITE_USAGE", "WEBSITE_VISIT", "MEDIA_PLAYBACK"):
        lines.write_structured_log(rows.where(F.col("event_type") == kind).coalesce(1), f"{path}/{kind.lower()}")
    return lines.source_inventory(spark, path, "*.txt")


# Retention

_LOADED = f"""loaded AS (SELECT {duck.usage_key()} AS event_key, type, app_name, window_title, url, title, timestamp, duration_seconds,
  TIMESTAMP '2024-01-31 00:00:00' AS created_at, id, user_id, CAST(timestamp AS DATE) AS event_date FROM usage_events)"""


@query("purge_older_than", needs=UE, ctes=_LOADED, sql="""
SELECT *, (SELECT count(*) FROM loaded WHERE timestamp < TIMESTAMP '2024-01-31 12:30:00' - INTERVAL 20 DAY) AS rows_deleted
FROM loaded WHERE timestamp >= TIMESTAMP '2024-01-31 12:30:00' - INTERVAL 20 DAY""")
def _(spark, sf):
    """What the table has after the job, and the job's count. The cutoff falls within a day."""
    path = loaded_table(spark, sf)
    [deleted] = dated_tables.purge_table(spark, path, "timestamp", dated_tables.USAGE_DDL, "2024-01-31 12:30:00", 20).first()
    return tables.read_usage_events(spark, path).withColumn("rows_deleted", F.lit(deleted).cast("long"))


@query("prune_before", needs=UE, ctes=_LOADED, sql="""
SELECT id, timestamp, (SELECT count(*) FROM loaded WHERE timestamp < TIMESTAMP '2024-01-12 00:00:00') AS removed_events,
  (SELECT count(*) FROM loaded WHERE timestamp >= TIMESTAMP '2024-01-12 00:00:00') AS remaining_events,
  '' AS last_shift_export_key, '' AS last_daily_export_date FROM loaded WHERE timestamp >= TIMESTAMP '2024-01-12 00:00:00'""")
def _(spark, sf):
    path = loaded_table(spark, sf)
    done = dated_tables.prune_table(spark, path, "timestamp", dated_tables.USAGE_DDL, "2024-01-12 00:00:00")
    return tables.read_usage_events(spark, path).select("id", "timestamp").join(done, F.lit(True))  # one row


@query("purge_rows", needs=UE, sql="""
SELECT id, (SELECT count(*) FROM usage_events WHERE timestamp < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY) AS rows_deleted
FROM usage_events WHERE timestamp >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY""")
def _(spark, sf):
    """The same on frames."""
    kept, deleted = lifecycle.purge_older_than(bind(spark, sf, "usage_events"), AS_OF, 20)
    return kept.select("id").join(deleted, F.lit(True))  # one row


@query("table_constraints", needs=UE, sql="""
SELECT part, rule, count(*) AS rows FROM planted, LATERAL (SELECT unnest([
  CASE WHEN type IS NULL THEN 'type_not_null' END, CASE WHEN type NOT IN ('app', 'web') THEN 'type_known' END,
  CASE WHEN length(app_name) > 255 THEN 'app_name_length' END, CASE WHEN duration_seconds < 0 THEN 'duration_range' END,
  CASE WHEN CAST(timestamp AS DATE) <> event_date THEN 'event_date_of_timestamp' END]) AS rule) r
WHERE rule IS NOT NULL GROUP BY part, rule""", ctes="""planted AS (SELECT id,
  CASE WHEN id % 17 = 0 THEN NULL WHEN id % 19 = 0 THEN 'note' ELSE type END AS type,
  CASE WHEN id % 23 = 0 THEN repeat(app_name, 60) ELSE app_name END AS app_name,
  CASE WHEN id % 29 = 0 THEN -1 WHEN id % 31 = 0 THEN NULL ELSE duration_seconds END AS duration_seconds,
  CASE WHEN id % 37 = 0 THEN timestamp + INTERVAL 1 DAY ELSE timestamp END AS timestamp, CAST(timestamp AS DATE) AS event_date, id % 4 AS part
  FROM usage_events)""")
def _(spark, sf):
    """Rows that break a rule, by part, of a table with faults in every column that has a rule of its own."""
    rows = tables.table_rows(bind(spark, sf, "usage_events"), timestamp_lit(AS_OF))
    faulty = rows.withColumns({
        "part": F.col("id") % 4,
        "type": F.expr("CASE WHEN id % 17 = 0 THEN NULL WHEN id % 19 = 0 THEN 'note' ELSE type END"),
        "app_name": F.expr("CASE WHEN id % 23 = 0 THEN repeat(app_name, 60) ELSE app_name END"),
        "duration_seconds": F.expr("CASE WHEN id % 29 = 0 THEN -1 WHEN id % 31 = 0 THEN NULL ELSE duration_seconds END"),
        "timestamp": F.expr("CASE WHEN id % 37 = 0 THEN timestamp + INTERVAL '1' DAY ELSE timestamp END")})
    path = scratch_dir(spark, "faulty")
    faulty.write.parquet(path)
    return tables.broken_rules(spark.read.parquet(path), by=["part"])


@query("range_summary", needs=UE, sql="""
SELECT type, count(*) AS event_count, count(DISTINCT app_name) AS exact_apps, count(DISTINCT url) AS exact_urls, true AS apps_within, true AS urls_within
FROM usage_events WHERE CAST(timestamp AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-28' GROUP BY type""")
def _(spark, sf):
    """Three weeks from stored days; the estimates are held against exact counts within the error that is stated."""
    events, path = bind(spark, sf, "usage_events"), scratch_dir(spark, "sketches")
    plans.daily_sketches(events).write.parquet(path)
    found = plans.range_summary(spark.read.parquet(path), "2024-01-08", "2024-01-28")
    exact = filters.in_week(events, "2024-01-08", "2024-01-28").groupBy("type").agg(
        F.count_distinct("app_name").alias("exact_apps"), F.count_distinct("url").alias("exact_urls"))

    def within(name):
        return (F.abs(F.col(f"unique_{name}") - F.col(f"exact_{name}")) <= plans.SKETCH_ERROR * F.col(f"exact_{name}")).alias(f"{name}_within")

    return found.join(exact, "type").select("type", "event_count", "exact_apps", "exact_urls", within("apps"), within("urls"))


@query("archive_week", needs=UE, sql="""
SELECT CASE WHEN CAST(timestamp AS DATE) BETWEEN DATE '2024-01-15' AND DATE '2024-01-21' THEN 'archive' ELSE 'live' END AS part,
  CAST(timestamp AS DATE) AS event_date, id, user_id, url, duration_seconds FROM usage_events""")
def _(spark, sf):
    path, archive = loaded_table(spark, sf), scratch_dir(spark, "archive")
    tables.archive_week(spark, path, archive, WEEK)
    live = tables.read_usage_events(spark, path)
    old = tables.read_usage_events(spark, f"{archive}/week={WEEK}")
    columns = ["event_date", "id", "user_id", "url", "duration_seconds"]
    return live.select(F.lit("live").alias("part"), *columns).unionByName(old.select(F.lit("archive").alias("part"), *columns))


_INTEGRITY = """keyed AS (SELECT event_key, count(*) AS copies FROM integrity_rows GROUP BY event_key),
kept AS (SELECT *, CAST(hour(timestamp) // 8 + 1 AS INT) AS right_shift, CASE WHEN event_type LIKE 'WEB%' THEN 'WEB' ELSE 'APP' END AS right_category
  FROM integrity_rows QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY timestamp, shift_id, event_type, category) = 1),
totals AS (SELECT (SELECT count(*) FROM keyed WHERE copies > 1) AS duplicate_keys,
  (SELECT CAST(sum(copies - 1) AS BIGINT) FROM keyed) AS duplicate_rows,
  (SELECT count(*) FROM kept WHERE shift_id <> right_shift) AS wrong_shift,
  (SELECT count(*) FROM kept WHERE category <> right_category) AS wrong_category)"""


@query("integrity_check", needs=("integrity_rows",), ctes=_INTEGRITY,
       sql="SELECT *, duplicate_rows + wrong_shift + wrong_category AS repaired, 'ISSUES' AS status FROM totals")
def _(spark, sf):
    return lifecycle.integrity_check(bind(spark, sf, "integrity_rows"))[0]


@query("integrity_repair", needs=("integrity_rows",), ctes=_INTEGRITY,
       sql="SELECT event_key, timestamp, right_shift AS shift_id, event_type, right_category AS category FROM kept")
def _(spark, sf):
    return lifecycle.integrity_check(bind(spark, sf, "integrity_rows"))[1]


@query("scheduled_exports", needs=UE, sql="""
SELECT 'shift' AS kind, strftime(d, '%Y-%m-%d') || '-shift' || s AS export_key
FROM generate_series(TIMESTAMP '2024-01-18 00:00:00', TIMESTAMP '2024-01-20 00:00:00', INTERVAL 1 DAY) AS g(d), range(1, 4) AS r(s)
WHERE d + INTERVAL 8 HOUR * s > TIMESTAMP '2024-01-18 08:00:00' AND d + INTERVAL 8 HOUR * s <= TIMESTAMP '2024-01-20 08:00:00'
  AND d + INTERVAL 8 HOUR * s > (SELECT min(timestamp) FROM usage_events)
UNION ALL SELECT 'day', strftime(d, '%Y-%m-%d')
FROM generate_series(TIMESTAMP '2024-01-18 00:00:00', TIMESTAMP '2024-01-19 00:00:00', INTERVAL 1 DAY) AS g(d)
WHERE d >= (SELECT date_trunc('day', min(timestamp)) FROM usage_events)""")
def _(spark, sf):
    return lifecycle.scheduled_exports(
        bind(spark, sf, "usage_events"), "2024-01-20 09:00:00", "2024-01-18-shift1", "2024-01-17")


