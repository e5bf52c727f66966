"""One log row for app, web and media events: keys, parsing, fan-out and consolidation."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrail.functions.timeparts import (
    log_timestamp, parse_event_ts, readable_duration, shift_id, timestamp_lit)
from daytrail.functions.web import extract_domain
from daytrail.operators.filters import on_date
from daytrail.operators.sequence import dedupe_events
from daytrail.operators.validation import whole_number
from daytrail.schemas import DAILY_CSV_COLUMNS, FACT_COLUMNS, UNIFIED_COLUMNS

# Event types of the fact tables and their categories.
FACT_TYPES = {
    "app_usage": "APP_USAGE",
    "website_visits": "WEBSITE_VISIT",
    "website_usage": "WEBSITE_USAGE",
    "media_playback": "MEDIA_PLAYBACK",
    "media_track_change": "MEDIA_TRACK_CHANGE",
}
CATEGORY_PREFIXES = {"APP_": "APP", "WEBSITE_": "WEB", "MEDIA_": "MEDIA"}
# Sections of a daily workbook.
CATEGORY_SECTIONS = {"APP": "Usage_Log", "WEB": "Browser_Log", "MEDIA": "Media_Log"}

# Payload fields of all event types, read as text.
PAYLOAD_FIELDS = ["logged_at", "started_at", "ended_at", "visited_at", "changed_at", "duration_seconds",
                  "process_name", "app_name", "window_title", "browser", "domain", "url", "page_title",
                  "source", "source_app", "title", "artist", "playback_state"]
PAYLOAD_DDL = ", ".join(f"{f} STRING" for f in PAYLOAD_FIELDS)


def event_category(event_type: Column) -> Column:
    return reduce(lambda c, item: c.when(event_type.startswith(item[0]), item[1]),
                  CATEGORY_PREFIXES.items(), F.when(F.lit(False), "")).otherwise("OTHER")


def normalize_event(df: DataFrame) -> DataFrame:
    """Payload columns of any event type to the unified row, with shift and key.

    Input: event_type and any of the payload fields, as text.
    """
    def field(name: str) -> Column:
        return F.nullif(F.col(name), F.lit("")) if name in df.columns else F.lit(None).cast("string")

    category = F.col("_category")
    moment = parse_event_ts(F.coalesce(*[field(f) for f in
                                         ("ended_at", "visited_at", "changed_at", "started_at", "logged_at")]))
    site = F.coalesce(field("domain"), extract_domain(field("url")))
    rows = df.withColumn("_category", event_category(F.col("event_type"))).withColumns({
        "_source": F.when(category == "APP", F.coalesce(field("process_name"), field("app_name")))
        .when(category == "MEDIA", field("source_app")).otherwise(F.coalesce(field("browser"), field("source"))),
        "_item": F.when(category == "APP", field("app_name"))
        .when(category == "MEDIA", F.concat_ws(" - ", field("title"), field("artist"))).otherwise(site),
        "_window": F.when(category == "APP", field("window_title"))
        .when(category == "WEB", field("page_title")).otherwise(field("title")),
        "_moment": moment,
        "_seconds": F.coalesce(whole_number(field("duration_seconds")), F.lit(0)),
    })
    passed = [c for c in ("id", "user_id") if c in df.columns]
    return with_key(rows.select(
        *passed, F.col("_moment").alias("timestamp"), F.col("_category").alias("category"),
        F.col("_source").alias("source"), F.col("_item").alias("item"), "event_type",
        F.col("_seconds").alias("duration_seconds"), F.col("_window").alias("window"),
        F.when(F.col("_category") == "WEB", field("url")).alias("url"),
    ).withColumn("shift_id", shift_id(F.col("timestamp"))))


# A missing field and an empty one make the same key, and a field's text cannot run into the next.
KEY_SEPARATOR = "\u001f"


def event_key(columns: Sequence[str] = ("timestamp", "event_type", "item", "window", "url",
                                        "duration_seconds"), precision: str = "microsecond") -> Column:
    """Deterministic key of a unified row; the same event always gets the same key."""
    ts, *rest = columns
    moment = log_timestamp(F.col(ts))
    if precision == "second":
        moment = F.substring(moment, 1, 19)
    return F.md5(F.concat_ws(KEY_SEPARATOR, F.coalesce(moment, F.lit("")), *[
        F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest]))


def with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("event_key", event_key())


_STRUCTURED = r"(?s)^\[([^\]]*)\] \| ([^|]*) \| (.*?) \| (\{.*\})$"


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """`[time] | CATEGORY | item | {json}` lines and plain JSON lines to unified rows.

    Input column `value`; a line that is neither has `event_type` NULL.
    """
    structured = F.regexp_extract("value", _STRUCTURED, 4)
    is_structured = structured != ""
    payload = F.from_json(F.when(is_structured, structured), f"event_type STRING, {PAYLOAD_DDL}")
    legacy = F.from_json(
        F.when(~is_structured & F.col("value").startswith("{"), F.col("value")),
        f"logged_at STRING, event_type STRING, data STRUCT<{PAYLOAD_DDL.replace(' STRING', ': STRING')}>")
    parsed = lines.select(
        F.col("value").alias("raw_line"), payload.alias("_s"), legacy.alias("_l"),
        F.when(is_structured, F.regexp_extract("value", _STRUCTURED, 1)).alias("_logged"))
    flat = parsed.select(
        "raw_line", F.coalesce("_s.event_type", "_l.event_type").alias("event_type"),
        F.coalesce("_logged", "_s.logged_at", "_l.logged_at", "_l.data.logged_at").alias("logged_at"),
        *[F.coalesce(f"_s.{f}", f"_l.data.{f}").alias(f) for f in PAYLOAD_FIELDS if f != "logged_at"])
    return flat


def structured_line(df: DataFrame) -> Column:
    """Inverse of the parser for unified rows."""
    payload = F.struct(
        "event_type", "duration_seconds",
        F.when(F.col("category") == "APP", F.col("item")).alias("app_name"),
        F.when(F.col("category") == "APP", F.col("source")).alias("process_name"),
        F.when(F.col("category") == "APP", F.col("window")).alias("window_title"),
        F.when(F.col("category") == "WEB", F.col("source")).alias("browser"),
        F.when(F.col("category") == "OTHER", F.col("source")).alias("source"),
        F.when(F.col("category").isin("WEB", "OTHER"), F.col("item")).alias("domain"),
        F.when(F.col("category") == "WEB", F.col("window")).alias("page_title"),
        "url",
        F.when(F.col("category") == "MEDIA", F.col("source")).alias("source_app"),
        F.when(F.col("category").isin("MEDIA", "OTHER"), F.col("window")).alias("title"),
        F.when(F.col("category") == "MEDIA",
               F.nullif(F.expr("substring(item, length(window) + 4)"), F.lit(""))).alias("artist"),
        log_timestamp(F.col("timestamp")).alias("ended_at"))
    item = F.regexp_replace(F.coalesce("item", F.lit("")), r"[|\r\n]", " ")
    return F.concat_ws(
        " | ", F.concat(F.lit("["), log_timestamp(F.col("timestamp")), F.lit("]")), F.col("category"), item,
        F.to_json(payload))


def fan_out_facts(df: DataFrame) -> dict[str, DataFrame]:
    """The fact tables of one set of typed payload rows."""
    return {table: df.where(F.col("event_type") == event_type).select(
        *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in FACT_COLUMNS[table]])
        for table, event_type in FACT_TYPES.items()}


def facts_as_payload(facts: dict[str, DataFrame]) -> DataFrame:
    """Typed payload rows of fact tables: the inverse of the fan-out."""
    rows = [df.select(F.lit(FACT_TYPES[table]).alias("event_type"),
                      *[F.col(c).cast("string") for c in df.columns if c in PAYLOAD_FIELDS])
            for table, df in facts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def combine_events(app: DataFrame, web: DataFrame) -> DataFrame:
    """App and web branches as one table; columns one side lacks are NULL."""
    return app.unionByName(web, allowMissingColumns=True)


def consolidate_logs(*sources: DataFrame) -> DataFrame:
    """Merge unified rows of several sources; the same event counts once, to the second.

    Sources write an application's process or its name as the source, so the key leaves the
    source out.
    """
    merged = reduce(lambda a, b: a.unionByName(b), [s.select(*UNIFIED_COLUMNS) for s in sources])
    keyed = merged.withColumn("event_key", event_key(precision="second"))
    return dedupe_events(keyed, ["event_key"], ["timestamp", F.col("source").asc_nulls_last()])


def daily_rows(df: DataFrame, day: dt.date | str, shift: int | None = None) -> DataFrame:
    """Daily (or one shift's) CSV rows."""
    rows = on_date(df, day)
    if shift is not None:
        rows = rows.where(shift_id(F.col("timestamp")) == shift)
    return rows.select(
        log_timestamp(F.col("timestamp")).alias("timestamp"), "category", "item", "duration_seconds",
        readable_duration(F.col("duration_seconds")).alias("duration_readable"), "source",
        "event_type", "window", "url").select(*DAILY_CSV_COLUMNS)


def read_daily_rows(rows: DataFrame) -> DataFrame:
    """Daily CSV rows (all text) back to unified rows."""
    def text(name: str) -> Column:
        return F.nullif(F.col(name), F.lit("")).alias(name)

    return rows.select(
        parse_event_ts(F.col("timestamp")).alias("timestamp"), text("category"), text("source"),
        text("item"), text("event_type"),
        F.coalesce(whole_number(F.col("duration_seconds")), F.lit(0)).alias("duration_seconds"),
        text("window"), text("url"))


def daily_sections(df: DataFrame, day: dt.date | str) -> DataFrame:
    """Log, shift and summary sections of a day in one frame with a `section` column."""
    rows = on_date(df, day).withColumn("_shift", F.concat(F.lit("Shift"), shift_id(F.col("timestamp"))))
    log = reduce(lambda c, i: c.when(F.col("category") == i[0], i[1]), CATEGORY_SECTIONS.items(),
                 F.when(F.lit(False), ""))
    listed = rows.withColumn("section", F.explode(F.filter(
        F.array(log, F.col("_shift")), lambda s: s.isNotNull())))
    body = listed.select(
        "section", log_timestamp(F.col("timestamp")).alias("timestamp"), "category", "item", "duration_seconds",
        F.lit(None).cast("string").alias("metric"))
    totals = rows.agg(
        F.coalesce(F.sum("duration_seconds"), F.lit(0)).alias("total_time_seconds"),
        F.count("*").alias("total_events"),
        *[F.coalesce(F.sum(F.when(F.col("category") == c, F.col("duration_seconds"))), F.lit(0))
          .alias(f"{c.lower()}_time_seconds") for c in CATEGORY_SECTIONS])
    summary = totals.unpivot([], totals.columns, "metric", "duration_seconds").select(
        F.lit("Summary").alias("section"), F.lit(None).cast("string").alias("timestamp"),
        F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("item"),
        "duration_seconds", "metric")
    return body.unionByName(summary)


def collect_since(log: DataFrame, since: str | dt.datetime, table: DataFrame | None = None) -> DataFrame:
    """Rows newer than `since` that the table does not have yet, each once."""
    new = dedupe_events(log.where(F.col("timestamp") > timestamp_lit(since)), ["event_key"], ["timestamp"])
    return new if table is None else new.join(table.select("event_key").distinct(), "event_key", "left_anti")
