"""Timestamp, shift and duration expressions. All times are zone-free UTC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from daytrail.functions.let import let

# Fixed values.
CHROMIUM_EPOCH_OFFSET_US = 11_644_473_600_000_000  # 1601-01-01 to 1970-01-01
TICKS_PER_SECOND = 10_000_000
SHIFT_HOURS = 8

_EPOCH = dt.datetime(1970, 1, 1)
_EPOCH_DATE = dt.date(1970, 1, 1)

_DATE = r"(\d{4})-?(\d{2})-?(\d{2})"
_CLOCK = r"(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
_ZONE = r"(Z|[+-]\d{2}(?::?\d{2})?)?"
# The forms that a cast reads, as nearly all texts have them; the others are taken apart first.
_COMMON = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?Z?)?$"
_ISO = rf"^(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{8}})(?:[T ]{_CLOCK}{_ZONE})?$"
_ISO_PARTS = rf"^{_DATE}(?:[T ]{_CLOCK}{_ZONE})?$"


def timestamp_lit(value: dt.datetime | dt.date | str) -> Column:
    """A zone-free timestamp literal."""
    if isinstance(value, str):
        return F.lit(value).cast("timestamp_ntz")
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def date_lit(value: dt.date | str) -> Column:
    return F.lit(str(value)).cast("date")


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", timestamp_lit(_EPOCH), ts)


def from_epoch_us(us: Column) -> Column:
    """Zone-free timestamp of microseconds since 1970."""
    return F.timestamp_add("MICROSECOND", us, timestamp_lit(_EPOCH))


def parse_event_ts(text: Column) -> Column:
    """ISO-8601 text to a UTC timestamp, NULL when it is not one.

    Dates and clocks may be in the extended or the compact form; an offset is applied, a text
    without one is taken as UTC. Week dates are not accepted.
    """
    return F.when(text.rlike(_COMMON), F.rtrim(text, F.lit("Z")).try_cast("timestamp_ntz")).when(
        text.rlike(_ISO), let(text, _parse_parts))


def _parse_parts(text: Column) -> Column:
    def part(i: int) -> Column:
        return F.regexp_extract(text, _ISO_PARTS, i)

    def or_zero(c: Column) -> Column:
        return F.when(c == "", F.lit("00")).otherwise(c)

    clock = F.concat_ws(":", or_zero(part(4)), or_zero(part(5)), or_zero(part(6)))
    local = F.concat(F.concat_ws("-", part(1), part(2), part(3)), F.lit(" "), clock, F.lit("."),
                     F.rpad(part(7), 6, "0"))
    zone = part(8)
    digits = F.rpad(F.regexp_replace(zone, "[Z:]", ""), 5, "0")
    minutes = F.substring(digits, 2, 2).cast("int") * 60 + F.substring(digits, 4, 2).cast("int")
    offset = F.when(zone.rlike(r"^\+"), minutes).when(zone.startswith("-"), -minutes).otherwise(0)
    return local.try_cast("timestamp_ntz") - F.make_dt_interval(mins=offset)


def chromium_ts(us: Column, when_zero: Column | None = None) -> Column:
    """Chromium history time (microseconds since 1601) to a timestamp; 0 gives `when_zero`."""
    return F.when(us == 0, when_zero if when_zero is not None else F.lit(None)).otherwise(
        from_epoch_us(us - F.lit(CHROMIUM_EPOCH_OFFSET_US)))


def firefox_ts(us: Column) -> Column:
    """Firefox history time (microseconds since 1970) to a timestamp."""
    return from_epoch_us(us)


def to_chromium_us(ts: Column) -> Column:
    """Timestamp to Chromium history time."""
    return epoch_us(ts) + F.lit(CHROMIUM_EPOCH_OFFSET_US)


def event_date(ts: Column) -> Column:
    return ts.cast("date")


def timestamp_local(ts: Column, zone: str) -> Column:
    """A UTC time on the clocks of a zone. Two times an hour apart may read alike when clocks go back."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def timestamp_utc(local: Column, zone: str) -> Column:
    """A zone's clock time in UTC: the first of two, and where clocks skip it, the time as long after the gap's start."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def shift_id(ts: Column, zone: str | None = None) -> Column:
    """Eight-hour shift 1, 2 or 3; each starts at its first hour and excludes its last. With a zone, by its clocks."""
    local = ts if zone is None else timestamp_local(ts, zone)
    return (F.floor(F.hour(local) / F.lit(SHIFT_HOURS)) + 1).cast("int")


def shift_day(ts: Column, zone: str) -> Column:
    """The zone's calendar day a shift belongs to."""
    return timestamp_local(ts, zone).cast("date")


def _clock(day: Column, hours: Column, zone: str | None) -> Column:
    local = day.cast("timestamp_ntz") + F.make_dt_interval(hours=hours)
    return local if zone is None else timestamp_utc(local, zone)


def shift_start(day: Column, shift: Column, zone: str | None = None) -> Column:
    """First time of a shift, in UTC. With a zone a shift begins by its clocks, so the one that a clock change falls into lasts
    seven or nine hours."""
    return _clock(day, (shift - 1) * SHIFT_HOURS, zone)


def shift_end(day: Column, shift: Column, zone: str | None = None) -> Column:
    """First time after a shift, in UTC."""
    return _clock(day, shift * SHIFT_HOURS, zone)


def shift_order(day: Column, shift: Column) -> Column:
    """Running number of a shift, three per day since 1970-01-01."""
    return F.datediff(day, F.lit(_EPOCH_DATE)) * 3 + shift - 1


def shift_from_order(order: Column) -> tuple[Column, Column]:
    """The (day, shift) a running number stands for."""
    day = F.date_add(F.lit(_EPOCH_DATE), F.floor(order / F.lit(3)).cast("int"))
    return day, (F.pmod(order, F.lit(3)) + 1).cast("int")


def shift_key(day: Column, shift: Column) -> Column:
    return F.concat(day.cast("string"), F.lit("-shift"), shift.cast("string"))


def readable_duration(seconds: Column) -> Column:
    """`1h 1m 1s`, `1m 0s`, `7s`."""
    total = F.greatest(F.coalesce(seconds.cast("long"), F.lit(0)), F.lit(0))
    hours, minutes, rest = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    return F.concat(
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "))).otherwise(""),
        F.when(total >= 60, F.concat(minutes.cast("string"), F.lit("m "))).otherwise(""),
        rest.cast("string"), F.lit("s"),
    )


def position_seconds(ticks: Column) -> Column:
    """Media position in 10 MHz ticks to seconds."""
    return ticks / F.lit(TICKS_PER_SECOND)


def log_timestamp(ts: Column) -> Column:
    """`2026-03-18 10:30:45.123456`"""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
