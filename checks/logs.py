"""Unified log rows: parsing, keys, fan-out, daily files, consolidation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import duck
from checks.bindings import DAY, bind, dated_log, facts
from checks.registry import query
from daytrail.functions import timeparts
from daytrail.operators import unified
from daytrail.plans import daily
from daytrail.schemas import DAILY_CSV_COLUMNS, FACT_COLUMNS
from daytrail.session import scratch_dir
from daytrail.sources import archive, collect, dated, files, lines

PAYLOAD = ("payload_rows",)
_ROW = 'timestamp, category, source, item, event_type, duration_seconds, "window", url'


def unified_rows(spark, sf):
    return unified.normalize_event(bind(spark, sf, "payload_rows"))


@query("event_category", needs=PAYLOAD, ctes=duck.UNIFIED, sql="SELECT id, category FROM unified")
def _(spark, sf):
    return bind(spark, sf, "payload_rows").select("id", unified.event_category(F.col("event_type")).alias("category"))


@query("normalize_event", needs=PAYLOAD, ctes=duck.UNIFIED, sql=f"SELECT id, user_id, {_ROW}, shift_id, event_key FROM unified")
def _(spark, sf):
    return unified_rows(spark, sf)


@query("event_key", needs=PAYLOAD, ctes=duck.UNIFIED, sql="SELECT id, event_key FROM unified")
def _(spark, sf):
    return unified_rows(spark, sf).select("id", unified.event_key().alias("event_key"))


@query("read_structured_log", needs=PAYLOAD, ctes=duck.UNIFIED, sql=f"SELECT {_ROW}, shift_id, event_key FROM unified")
def _(spark, sf):
    """Plain JSON lines for web rows, structured lines for the others, and lines that are no event."""
    rows = bind(spark, sf, "payload_rows")
    fields = [c for c in rows.columns if c not in ("id", "user_id", "event_type")]
    legacy = rows.where("event_type LIKE 'WEB%'").select(F.to_json(F.struct(
        F.lit("2024-01-01T00:00:00Z").alias("logged_at"), "event_type", F.struct(*fields).alias("data"))).alias("value"))
    normal = unified_rows(spark, sf).where("category <> 'WEB'")
    structured = normal.select(unified.structured_line(normal).alias("value"))
    noise = rows.select(F.concat(F.lit("note "), F.col("id").cast("string")).alias("value"))
    path = scratch_dir(spark, "log")
    legacy.unionByName(structured).unionByName(noise).write.text(path)
    return lines.read_structured_log(spark, path)


@query("write_structured_log", needs=PAYLOAD, ctes=duck.UNIFIED, sql=f"SELECT {_ROW}, shift_id, event_key FROM unified")
def _(spark, sf):
    path = scratch_dir(spark, "log")
    lines.write_structured_log(unified_rows(spark, sf), path)
    return lines.read_structured_log(spark, path)


def _fact_sql(table: str, event_type: str) -> str:
    text = [f"CAST({c} AS VARCHAR)" + f" AS {c}" for c in FACT_COLUMNS[table]]
    return f"SELECT '{event_type}' AS event_type, {', '.join(text)} FROM {table}"


@query("fan_out_facts", needs=("app_usage", "website_visits", "website_usage", "media_playback", "media_track_change"),
       sql="\nUNION ALL BY NAME ".join(_fact_sql(t, e) for t, e in unified.FACT_TYPES.items()))
def _(spark, sf):
    typed = unified.facts_as_payload(facts(spark, sf))
    return unified.facts_as_payload(unified.fan_out_facts(typed))


@query("read_fact_logs", needs=tuple(FACT_COLUMNS), sql="\nUNION ALL BY NAME ".join(_fact_sql(t, e) for t, e in unified.FACT_TYPES.items()))
def _(spark, sf):
    path = scratch_dir(spark, "facts")
    files.write_fact_logs(facts(spark, sf), path)
    return unified.facts_as_payload(files.read_fact_logs(spark, path))


_TIMES = {"app_usage": "started_at", "website_visits": "visited_at", "website_usage": "started_at", "media_playback": "started_at", "media_track_change": "changed_at"}


@query("archive_facts", needs=tuple(FACT_COLUMNS), sql="\nUNION ALL BY NAME ".join(
    _fact_sql(t, e).replace(f"FROM {t}", f", CASE WHEN CAST({_TIMES[t]} AS DATE) BETWEEN DATE '2024-01-15' AND DATE '2024-01-21' THEN 'archive' ELSE 'live' END AS part FROM {t}")
    for t, e in unified.FACT_TYPES.items()))
def _(spark, sf):
    """All rows of the five tables, those of one week from its archive."""
    path, folder = scratch_dir(spark, "facts"), scratch_dir(spark, "archive")
    dated.write_facts(facts(spark, sf), path)
    archive.archive_facts(spark, path, folder, DAY)
    live, old = dated.read_facts(spark, path), archive.read_archive(spark, folder, DAY)
    parts = [unified.facts_as_payload(held).withColumn("part", F.lit(name)) for name, held in (("live", live), ("archive", old))]
    return parts[0].unionByName(parts[1])


@query("combine_events", needs=("usage_events",), sql="SELECT id, type, app_name, window_title, url, title FROM usage_events")
def _(spark, sf):
    e = bind(spark, sf, "usage_events")
    return unified.combine_events(
        e.where("type = 'app'").select("id", "type", "app_name", "window_title"),
        e.where("type = 'web'").select("id", "type", "app_name", "url", "title"))


_DAILY = f"""SELECT {duck.micros('timestamp')} AS timestamp, category, item, CAST(duration_seconds AS VARCHAR) AS duration_seconds,
  {duck.READABLE} AS duration_readable, source, event_type, "window", url FROM unified WHERE {duck.one_day('timestamp', DAY)}"""


@query("export_daily_csv", needs=PAYLOAD, ctes=duck.UNIFIED, sql=_DAILY)
def _(spark, sf):
    out = scratch_dir(spark, "daily")
    files.export_daily_csv(dated_log(spark, sf), DAY, out)
    return files.read_daily_csv(spark, f"{out}/date={DAY}")


@query("export_shift_csv", needs=PAYLOAD, ctes=duck.UNIFIED, sql=_DAILY + " AND shift_id = 2")
def _(spark, sf):
    out = scratch_dir(spark, "shift")
    files.export_shift_csv(dated_log(spark, sf), DAY, 2, out)
    return files.read_daily_csv(spark, f"{out}/date={DAY}/shift_id=2")


@query("export_all_days", needs=PAYLOAD, ctes=duck.UNIFIED, sql=_DAILY.split(" WHERE ")[0])
def _(spark, sf):
    out = scratch_dir(spark, "days")
    files.export_all_days(unified_rows(spark, sf), out)
    return files.read_daily_csv(spark, out).select(*DAILY_CSV_COLUMNS)


@query("daily_sections", needs=PAYLOAD, ctes=duck.UNIFIED + f""",
today AS (SELECT * FROM unified WHERE {duck.one_day('timestamp', DAY)})""", sql=f"""
SELECT CASE category WHEN 'APP' THEN 'Usage_Log' WHEN 'WEB' THEN 'Browser_Log' ELSE 'Media_Log' END AS section,
  {duck.micros('timestamp')} AS timestamp, category, item, duration_seconds, NULL AS metric FROM today
UNION ALL SELECT 'Shift' || shift_id, {duck.micros('timestamp')}, category, item, duration_seconds, NULL FROM today
UNION ALL SELECT 'Summary', NULL, NULL, NULL, CAST(coalesce(sum(duration_seconds), 0) AS BIGINT), 'total_time_seconds' FROM today
UNION ALL SELECT 'Summary', NULL, NULL, NULL, count(*), 'total_events' FROM today
UNION ALL SELECT 'Summary', NULL, NULL, NULL, CAST(coalesce(sum(duration_seconds) FILTER (category = c), 0) AS BIGINT), lower(c) || '_time_seconds'
  FROM (SELECT unnest(['APP', 'WEB', 'MEDIA']) AS c) LEFT JOIN today ON true GROUP BY c""")
def _(spark, sf):
    return unified.daily_sections(dated_log(spark, sf), DAY)


@query("shift_summary", needs=PAYLOAD, ctes=duck.UNIFIED, sql=f"""
SELECT shift_id, category, CAST(grouping_id(shift_id, category) AS INT) AS level,
  CAST(sum(duration_seconds) AS BIGINT) AS total_seconds, count(*) AS events
FROM unified WHERE {duck.one_day('timestamp', DAY)} GROUP BY ROLLUP (shift_id, category)""")
def _(spark, sf):
    return daily.shift_summary(dated_log(spark, sf), DAY)


@query("consolidate_logs", needs=PAYLOAD, ctes=duck.UNIFIED, sql=f"""
SELECT {_ROW}, {duck.unified_key(second=True)} AS event_key FROM unified
QUALIFY row_number() OVER (PARTITION BY {duck.unified_key(second=True)} ORDER BY timestamp, source NULLS LAST) = 1""")
def _(spark, sf):
    path = scratch_dir(spark, "legacy")
    rows = unified_rows(spark, sf)
    lines.write_structured_log(rows, f"{path}/log")
    files.write_fact_logs(unified.fan_out_facts(bind(spark, sf, "payload_rows")), f"{path}/facts")
    files.export_all_days(rows, f"{path}/days")
    from_facts = unified.normalize_event(unified.facts_as_payload(files.read_fact_logs(spark, f"{path}/facts")))
    return unified.consolidate_logs(
        lines.read_structured_log(spark, f"{path}/log"), from_facts,
        unified.read_daily_rows(files.read_daily_csv(spark, f"{path}/days")))


@query("collect_since", needs=PAYLOAD, ctes=duck.UNIFIED, sql="""
SELECT event_key, min(timestamp) AS timestamp FROM unified WHERE timestamp > TIMESTAMP '2024-01-12 00:00:00'
AND event_key NOT IN (SELECT event_key FROM unified WHERE category = 'WEB') GROUP BY event_key""")
def _(spark, sf):
    rows = unified_rows(spark, sf)
    return unified.collect_since(rows, "2024-01-12 00:00:00", rows.where("category = 'WEB'")).select("event_key", "timestamp")


@query("collect_job", needs=PAYLOAD, ctes=duck.UNIFIED + """,
once AS (SELECT * FROM unified QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY timestamp) = 1),
early AS (SELECT * FROM once WHERE timestamp <= TIMESTAMP '2024-01-16 00:00:00'),
late AS (SELECT * FROM once WHERE timestamp > (SELECT max(timestamp) FROM early)),
found AS (SELECT * FROM once WHERE timestamp > TIMESTAMP '2024-01-12 00:00:00')""", sql="""
SELECT 1 AS run, 'scheduled' AS kind, NULL::TIMESTAMP AS since, max(timestamp) AS mark, count(*) AS events_collected, count(*) AS events_written,
  false AS dry_run, count(*) AS table_rows FROM early
UNION ALL SELECT 2, 'scheduled', (SELECT max(timestamp) FROM early), max(timestamp), count(*), count(*), true, (SELECT count(*) FROM early) FROM late
UNION ALL SELECT 3, 'scheduled', (SELECT max(timestamp) FROM early), max(timestamp), count(*), count(*), false, (SELECT count(*) FROM once) FROM late
UNION ALL SELECT 4, 'scheduled', (SELECT max(timestamp) FROM once), (SELECT max(timestamp) FROM once), 0, 0, false, (SELECT count(*) FROM once)
UNION ALL SELECT 5, 'manual', TIMESTAMP '2024-01-12 00:00:00', max(timestamp), count(*), 0, false, (SELECT count(*) FROM once) FROM found""")
def _(spark, sf):
    """A first run over half of the log, then over all of it: dry, in earnest, again, and by hand from a given time."""
    path, progress = scratch_dir(spark, "collected"), scratch_dir(spark, "progress")
    log = unified_rows(spark, sf)
    half = log.where("timestamp <= '2024-01-16 00:00:00'")
    out = None
    for run, (rows, given) in enumerate([(half, {}), (log, {"dry_run": True}), (log, {}), (log, {}), (log, {"kind": "manual", "since": "2024-01-12 00:00:00"})], 1):
        done = collect.collect_log(rows, path, progress, **given).withColumns({
            "run": F.lit(run), "table_rows": F.lit(dated.read_log(spark, path).count()).cast("long")})
        out = done if out is None else out.unionByName(done)
    return out


_ZONE = "Europe/Berlin"


@query("shifts_in_zone", needs=("base_events",), ctes=f"""
moved AS (SELECT id, timestamp + INTERVAL 74 DAY AS ts FROM base_events UNION ALL SELECT id + 1000000000, timestamp + INTERVAL 284 DAY FROM base_events),
clocks AS (SELECT *, timezone('{_ZONE}', timezone('UTC', ts)) AS local FROM moved),
shifts AS (SELECT *, CAST(local AS DATE) AS day, CAST(hour(local) // 8 + 1 AS INT) AS shift_id FROM clocks)""", sql=f"""
SELECT id, ts AS timestamp, local AS timestamp_local, day, shift_id,
  timezone('UTC', timezone('{_ZONE}', CAST(day AS TIMESTAMP) + INTERVAL 8 HOUR * (shift_id - 1))) AS shift_start,
  timezone('UTC', timezone('{_ZONE}', CAST(day AS TIMESTAMP) + INTERVAL 8 HOUR * shift_id)) AS shift_end,
  CASE WHEN day = DATE '2024-03-31' AND shift_id = 1 THEN 7 WHEN day = DATE '2024-10-27' AND shift_id = 1 THEN 9 ELSE 8 END AS hours
FROM shifts""")
def _(spark, sf):
    """Events of two months that have a clock change each, in shifts by local clocks."""
    base = bind(spark, sf, "base_events").select("id", "timestamp")
    moved = base.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL '74' DAY")).unionByName(
        base.select((F.col("id") + 1_000_000_000).alias("id"), (F.col("timestamp") + F.expr("INTERVAL '284' DAY")).alias("timestamp")))
    ts = F.col("timestamp")
    rows = moved.withColumns({"timestamp_local": timeparts.timestamp_local(ts, _ZONE), "day": timeparts.shift_day(ts, _ZONE),
                              "shift_id": timeparts.shift_id(ts, _ZONE)})
    start, end = (f(F.col("day"), F.col("shift_id"), _ZONE) for f in (timeparts.shift_start, timeparts.shift_end))
    hours = F.timestamp_diff("HOUR", F.col("shift_start"), F.col("shift_end")).cast("int")
    return rows.withColumns({"shift_start": start, "shift_end": end}).withColumn("hours", hours)
