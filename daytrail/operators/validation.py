"""Accept or reject raw events, redact them, and shape them for the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrail.functions.let import let
from daytrail.functions.privacy import redact_text, redact_url
from daytrail.functions.timeparts import parse_event_ts
from daytrail.schemas import OWNER_COLUMNS

# Field limits and load defaults.
MAX_APP_NAME = 255
MAX_WINDOW_TITLE = 1000
MAX_URL = 2000
MAX_TITLE = 1000
MAX_DURATION_SECONDS = 86400
UNKNOWN_APP = "Unknown"
WEB_APP = "Chrome"


def normalize_web(df: DataFrame) -> DataFrame:
    """Fill the canonical time and duration of web rows from their browser aliases."""
    web = F.col("type") == "web"

    def filled(name: str, alias: str) -> Column:
        return F.when(web, F.coalesce(name, alias)).otherwise(F.col(name))

    return df.withColumns({
        "timestamp": filled("timestamp", "visit_time"),
        "duration_seconds": filled("duration_seconds", "visit_duration"),
    }).drop("visit_time", "visit_duration")


def whole_number(text: Column) -> Column:
    """A whole number written as `300` or `300.0`; NULL for anything else."""
    return F.coalesce(text.try_cast("long"), F.when(text.contains("."), let(
        text, lambda t: F.regexp_extract(F.trim(t), r"^([+-]?[0-9]+)\.0*$", 1).try_cast("long"))))


def reject_reasons(event_type: Column) -> Column:
    """Array of the rules a raw event breaks."""
    app, web = event_type == "app", event_type == "web"
    c = F.col
    duration = whole_number(c("duration_seconds"))
    rules = [
        ("type_unknown", ~F.coalesce(app | web, F.lit(False))),
        ("app_name_missing", app & c("app_name").isNull()),
        ("app_name_too_long", app & (F.length("app_name") > MAX_APP_NAME)),
        ("window_title_too_long", app & (F.length("window_title") > MAX_WINDOW_TITLE)),
        ("process_id_invalid", app & c("process_id").isNotNull() & whole_number(c("process_id")).isNull()),
        ("url_missing", web & c("url").isNull()),
        ("url_too_long", web & (F.length("url") > MAX_URL)),
        ("url_scheme", web & ~c("url").rlike("^https?://")),
        ("title_too_long", web & (F.length("title") > MAX_TITLE)),
        ("duration_invalid", c("duration_seconds").isNotNull()
         & ~F.coalesce(duration.between(0, MAX_DURATION_SECONDS), F.lit(False))),
        ("timestamp_invalid", parse_event_ts(c("timestamp")).isNull()),
    ]
    # An array function with a lambda would take the rules out of generated code.
    return F.array_remove(F.array(*[F.when(broken, name).otherwise("") for name, broken in rules]), "")


def validate_events(df: DataFrame, default_type: str | None = None) -> DataFrame:
    """Add `reasons`, empty for a good event. Lengths are those before redaction."""
    event_type = F.coalesce("type", F.lit(default_type)) if default_type else F.col("type")
    typed = df.withColumn("type", event_type)
    reasons = reject_reasons(F.col("type"))
    # An owner that cannot be read must not become no owner, who is one user.
    wrong = [F.when(F.col(c).isNotNull() & whole_number(F.col(c)).isNull(), f"{c}_invalid").otherwise("") for c in _owner_text(df)]
    return typed.withColumn("reasons", F.concat(reasons, F.array_remove(F.array(*wrong), "")) if wrong else reasons)


def _owner_text(df: DataFrame) -> list[str]:
    """Owner columns that are text, as lines have them."""
    return [c for c, kind in df.dtypes if c in OWNER_COLUMNS and kind == "string"]


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of a validated frame."""
    return df.where(F.size("reasons") == 0).drop("reasons"), df.where(F.size("reasons") > 0)


def redact_events(df: DataFrame) -> DataFrame:
    """Redact window titles, page titles and URLs."""
    return df.withColumns({
        "window_title": redact_text(F.col("window_title")),
        "title": redact_text(F.col("title")),
        "url": redact_url(F.col("url")),
    })


def apply_load_defaults(df: DataFrame, ingest_time: Column) -> DataFrame:
    """Event columns of accepted rows, with the defaults of their type."""
    web = F.col("type") == "web"
    ts = F.col("timestamp")
    if dict(df.dtypes)["timestamp"] == "string":
        ts = parse_event_ts(ts)
    duration = F.col("duration_seconds")
    if dict(df.dtypes)["duration_seconds"] == "string":
        duration = whole_number(duration)
    blank = F.lit("")
    text = _owner_text(df)
    kept = [whole_number(F.col(c)).alias(c) if c in text else c for c in OWNER_COLUMNS if c in df.columns]
    return df.select(
        *kept,
        "type",
        F.when(web, F.lit(WEB_APP)).otherwise(F.coalesce("app_name", F.lit(UNKNOWN_APP))).alias("app_name"),
        F.when(~web, F.coalesce("window_title", blank)).alias("window_title"),
        F.when(web, F.coalesce("url", blank)).alias("url"),
        F.when(web, F.coalesce("title", blank)).alias("title"),
        F.coalesce(ts, ingest_time).alias("timestamp"),
        F.coalesce(duration.cast("int"), F.lit(0)).alias("duration_seconds"),
    )


def clean_events(df: DataFrame, ingest_time: Column, default_type: str | None = None
                 ) -> tuple[DataFrame, DataFrame]:
    """(loadable events, rejects) of raw rows: normalise, validate, redact, default."""
    valid, rejects = split_valid(validate_events(normalize_web(df), default_type))
    return apply_load_defaults(redact_events(valid), ingest_time), rejects
