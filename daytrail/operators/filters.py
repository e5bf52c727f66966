"""Row filters. Every "now" is an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrail.functions.timeparts import date_lit, event_date, timestamp_lit
from daytrail.functions.web import is_web_url


def _as_datetime(value: dt.datetime | dt.date | str) -> dt.datetime:
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return value


def _prune_from(df: DataFrame, first_day: dt.date) -> DataFrame:
    """Skip whole partitions where the table has them."""
    return df.where(F.col("event_date") >= date_lit(first_day)) if "event_date" in df.columns else df


def by_type(df: DataFrame, event_type: str) -> DataFrame:
    return df.where(F.col("type") == event_type)


def within_days(df: DataFrame, as_of: dt.datetime | str, days: int, inclusive: bool = True,
                ts: str = "timestamp") -> DataFrame:
    """Rows of the last `days`; reports include the exact cutoff, exports do not."""
    cutoff = _as_datetime(as_of) - dt.timedelta(days=days)
    bound = timestamp_lit(cutoff)
    newer = F.col(ts) >= bound if inclusive else F.col(ts) > bound
    return _prune_from(df, cutoff.date()).where(newer)


def since_watermark(df: DataFrame, watermark: dt.datetime | int | str | None, ts: str = "timestamp"
                    ) -> DataFrame:
    """Rows strictly newer than the last seen value; all rows when there is none."""
    if watermark is None:
        return df
    bound = F.lit(watermark) if isinstance(watermark, int) else timestamp_lit(watermark)
    return df.where(F.col(ts) > bound)


def drop_blank_titles(df: DataFrame, title: str = "title") -> DataFrame:
    return df.where(F.trim(F.regexp_replace(title, r"\s", " ")) != "")


def web_urls_only(df: DataFrame, url: str = "url") -> DataFrame:
    return df.where(is_web_url(F.col(url)))


def on_date(df: DataFrame, day: dt.date | str, ts: str = "timestamp") -> DataFrame:
    """Rows of one calendar day, as a range the scan can use."""
    start = _as_datetime(day)
    if "event_date" in df.columns:
        df = df.where(F.col("event_date") == date_lit(start.date()))
    return df.where((F.col(ts) >= timestamp_lit(start))
                    & (F.col(ts) < timestamp_lit(start + dt.timedelta(days=1))))


def in_week(df: DataFrame, start: dt.date | str, end: dt.date | str | None = None,
            ts: str = "timestamp") -> DataFrame:
    """Rows from `start` to `end`, both days included; a week when `end` is left out."""
    first = _as_datetime(start)
    last = _as_datetime(end) if end is not None else first + dt.timedelta(days=6)
    if "event_date" in df.columns:
        df = df.where(F.col("event_date").between(date_lit(first.date()), date_lit(last.date())))
    return df.where((F.col(ts) >= timestamp_lit(first))
                    & (F.col(ts) < timestamp_lit(last + dt.timedelta(days=1))))


def complete_days(df: DataFrame, now: dt.datetime | str, ts: str = "timestamp") -> DataFrame:
    """Rows of days that are over at `now`."""
    midnight = _as_datetime(now).replace(hour=0, minute=0, second=0, microsecond=0)
    if "event_date" in df.columns:
        df = df.where(F.col("event_date") < date_lit(midnight.date()))
    return df.where(F.col(ts) < timestamp_lit(midnight))


def day_of(ts: str = "timestamp") -> Column:
    return event_date(F.col(ts)).alias("date")


def newest_first(df: DataFrame, ts: str = "timestamp", tie: str = "id") -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc())


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First `n` rows in an order, picked per task before they meet."""
    return df.orderBy(*order).limit(n)
