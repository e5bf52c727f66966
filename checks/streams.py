"""Streams over files derived from the given tables, each run until its folder is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import duck
from checks.bindings import AS_OF, bind
from checks.clean import _raw_with_id
from checks.registry import query
from daytrail.functions.timeparts import timestamp_lit
from daytrail.session import scratch_dir
from daytrail.sources import lines, tables
from daytrail.streaming import ingest, windows

UE = ("usage_events",)
_SPLIT = "2024-01-16 00:00:00"


def _halves(df):
    """Earlier and later rows: a stream run after each sees its files in time order."""
    return df.where(F.col("timestamp") < _SPLIT), df.where(F.col("timestamp") >= _SPLIT)


def _event_stream(spark, path, schema):
    return spark.readStream.schema(schema).parquet(path)


_INGESTED = duck.LOADABLE + f""",
ingested AS (SELECT {duck.usage_key()} AS event_key, type, app_name, window_title, url, title, timestamp, duration_seconds,
  CAST(timestamp AS DATE) AS event_date, id, user_id,
  row_number() OVER (PARTITION BY user_id, {duck.usage_key()} ORDER BY id) AS copy
  FROM (SELECT *, id % 3 AS user_id FROM loadable UNION ALL SELECT * REPLACE (id + 1000000000 AS id), id % 3 + 3 FROM loadable))"""


@query("ingest_stream", needs=("raw_events",), ctes=_INGESTED, sql="SELECT * EXCLUDE (copy) FROM ingested WHERE copy = 1")
def _(spark, sf):
    src, out = scratch_dir(spark, "lines"), scratch_dir(spark, "ingest")
    raw = bind(spark, sf, "raw_events").withColumn("user_id", F.col("id") % 3)
    twice = raw.withColumns({"id": F.col("id") + 1_000_000_000, "user_id": F.col("user_id") + 3})  # the same lines of other users
    text = lines.event_lines(raw.unionByName(twice))
    for _ in range(2):  # the same lines again change nothing
        text.write.mode("append").text(src)
        ingest.ingest_stream(spark, src, f"{out}/events", f"{out}/rejects", f"{out}/checkpoint", AS_OF).awaitTermination()
    return tables.read_usage_events(spark, f"{out}/events").drop("created_at")


@query("stream_event_lines", needs=("raw_events",), sql="""
SELECT type, app_name, window_title, process_id, url, title, timestamp, visit_time, duration_seconds, visit_duration,
  CAST(id AS VARCHAR) AS id, NULL::VARCHAR AS user_id, false AS malformed FROM raw_events""")
def _(spark, sf):
    src, out = scratch_dir(spark, "lines"), scratch_dir(spark, "feed")
    lines.event_lines(bind(spark, sf, "raw_events")).write.text(src)
    windows.run_to_table(lines.stream_event_lines(spark, src), out, f"{out}-checkpoint").awaitTermination()
    return spark.read.parquet(out).drop("raw_line")


_LINE_REASONS = """line_reasons AS (SELECT CASE WHEN id % 50 = 0 THEN 'malformed_json'
  ELSE trim(replace(replace(reasons, 'process_id_invalid', ''), ',,', ','), ',') END AS reasons FROM validated)"""


@query("ingest_rejects", needs=("raw_events",), ctes=f"{duck.VALIDATED}, {_LINE_REASONS}",
       sql="SELECT reasons, count(*) AS rows FROM line_reasons WHERE reasons <> '' GROUP BY reasons")
def _(spark, sf):
    events, rejects = ingest.clean_lines(_raw_with_id(spark, sf), timestamp_lit(AS_OF))
    out = tables.reject_rows(rejects, "lines", timestamp_lit(AS_OF))
    return out.groupBy(F.concat_ws(",", "reasons").alias("reasons")).agg(F.count("*").alias("rows"))


@query("upsert_batch", needs=UE, ctes=f"""
keyed AS (SELECT *, {duck.usage_key()} AS event_key FROM usage_events)""", sql="""
SELECT DISTINCT event_key, CAST(timestamp AS DATE) AS event_date FROM keyed
WHERE event_key NOT IN (SELECT event_key FROM keyed WHERE timestamp < TIMESTAMP '2024-01-12 00:00:00')""")
def _(spark, sf):
    events = bind(spark, sf, "usage_events")
    at = timestamp_lit(AS_OF)
    batch = tables.table_rows(events.unionByName(events.where("type = 'web'")), at)  # with copies
    loaded = tables.table_rows(events.where("timestamp < '2024-01-12'"), at)
    return tables.new_rows(batch, loaded).select("event_key", "event_date")


@query("dedupe_stream", needs=UE, sql="SELECT DISTINCT type, app_name, window_title, url FROM usage_events")
def _(spark, sf):
    src, out = scratch_dir(spark, "events"), scratch_dir(spark, "unique")
    events = bind(spark, sf, "usage_events")
    events.write.parquet(src)
    stream = windows.dedupe_stream(_event_stream(spark, src, events.schema), "60 days")
    windows.run_to_table(stream, out, f"{out}-checkpoint").awaitTermination()
    return spark.read.parquet(out).select("type", "app_name", "window_title", "url")


_CHANGED = """SELECT id FROM (SELECT *, lag(id) OVER w AS p, lag(app_name) OVER w AS a, lag(window_title) OVER w AS t
FROM usage_events WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, id))
WHERE p IS NULL OR app_name IS DISTINCT FROM a OR window_title IS DISTINCT FROM t"""


def _closing(events):
    """The events and, per stream, one far later row, which lets the watermark pass all others."""
    last = events.agg(F.max(F.struct("timestamp", *[c for c in events.columns if c != "timestamp"])).alias("r")).select("r.*")
    return events.unionByName(last.withColumns({
        "timestamp": F.col("timestamp") + F.expr("INTERVAL '60' DAY"), "type": F.lit("end"), "app_name": F.lit("end")}))


@query("changed_only_stream", needs=UE, sql=_CHANGED)
def _(spark, sf):
    """In two runs, the second of which starts from the first one's state; each run's rows come in no order."""
    src, out = scratch_dir(spark, "events"), scratch_dir(spark, "changes")
    events = bind(spark, sf, "usage_events")
    for half in _halves(_closing(events)):
        half.repartition(3, "id").write.mode("append").parquet(src)
        changes = windows.changed_only_stream(_event_stream(spark, src, events.schema), "1 hour")
        windows.run_to_table(changes, out, f"{out}-checkpoint").awaitTermination()
    return spark.read.parquet(out).select("id")


@query("session_stream", needs=UE, ctes="""
gaps AS (SELECT *, epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w) AS gap FROM usage_events
  WINDOW w AS (PARTITION BY user_id, app_name, window_title ORDER BY timestamp, id)),
runs AS (SELECT *, sum(CASE WHEN gap <= 86400000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, app_name, window_title ORDER BY timestamp, id) AS run FROM gaps)""",
       sql="""
SELECT user_id, app_name, window_title, min(timestamp) AS started_at, max(timestamp) AS ended_at, count(*) AS n_events,
  CAST(sum(duration_seconds) AS BIGINT) AS duration_seconds FROM runs GROUP BY user_id, app_name, window_title, run""")
def _(spark, sf):
    src, out = scratch_dir(spark, "events"), scratch_dir(spark, "sessions")
    events = bind(spark, sf, "usage_events")
    _closing(events).write.parquet(src)
    stream = windows.session_stream(_event_stream(spark, src, events.schema), "24 hours", "1 hour")
    windows.run_to_table(stream, out, f"{out}-checkpoint").awaitTermination()
    return spark.read.parquet(out)


@query("daily_summary_stream", needs=UE, sql="""
SELECT CAST(timestamp AS DATE) AS date, type, count(*) AS event_count, count(DISTINCT app_name) AS exact_apps, count(DISTINCT url) AS exact_urls,
  true AS apps_near, true AS urls_near FROM usage_events GROUP BY 1, 2""")
def _(spark, sf):
    src, out = scratch_dir(spark, "events"), scratch_dir(spark, "summary")
    events = bind(spark, sf, "usage_events")
    _closing(events).write.parquet(src)
    stream = windows.daily_summary_stream(_event_stream(spark, src, events.schema), "1 hour")
    windows.run_to_table(stream, out, f"{out}-checkpoint").awaitTermination()
    exact = events.groupBy(F.col("timestamp").cast("date").alias("date"), "type").agg(
        F.count_distinct("app_name").alias("exact_apps"), F.count_distinct("url").alias("exact_urls"))

    def near(name):  # within four standard errors of the estimate, which is made for an error of 0.05
        return (F.abs(F.col(f"unique_{name}") - F.col(f"exact_{name}")) <= 0.2 * F.col(f"exact_{name}")).alias(f"{name}_near")

    return spark.read.parquet(out).join(exact, ["date", "type"]).select(
        "date", "type", "event_count", "exact_apps", "exact_urls", near("apps"), near("urls"))
