"""Retention, pruning, archiving and integrity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrail.functions.timeparts import shift_from_order, shift_id, shift_key, shift_order, timestamp_lit
from daytrail.operators.sequence import dedupe_events
from daytrail.operators.unified import event_category

# Fixed value.
RETENTION_DAYS = 90


def purge_older_than(df: DataFrame, as_of: dt.datetime | str, days: int = RETENTION_DAYS,
                     ts: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """(kept rows, one row with `rows_deleted`). Rows without a time are kept."""
    moment = dt.datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    old = F.coalesce(F.col(ts) < timestamp_lit(moment - dt.timedelta(days=days)), F.lit(False))
    return df.where(~old), df.agg(F.count_if(old).alias("rows_deleted"))


def prune_before(df: DataFrame, cutoff: dt.datetime | str, ts: str = "timestamp"
                 ) -> tuple[DataFrame, DataFrame]:
    """(rows from the cutoff on and those without a time, one summary row); the export state starts anew."""
    old = F.coalesce(F.col(ts) < timestamp_lit(cutoff), F.lit(False))
    summary = df.agg(
        F.count_if(old).alias("removed_events"), F.count_if(~old).alias("remaining_events"),
        F.lit("").alias("last_shift_export_key"), F.lit("").alias("last_daily_export_date"))
    return df.where(~old), summary


def integrity_check(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one report row, repaired frame) of rows event_key, timestamp, shift_id, event_type, category.

    A duplicate's removal, a corrected shift and a corrected category of a kept row count one each.
    """
    per_key = df.groupBy("event_key").agg(F.count("*").alias("_copies"))
    duplicates = per_key.agg(
        F.count_if(F.col("_copies") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"))
    kept = dedupe_events(df, ["event_key"], ["timestamp", "shift_id", "event_type", "category"])
    right_shift, right_category = shift_id(F.col("timestamp")), event_category(F.col("event_type"))
    wrong = kept.agg(
        F.count_if(~F.col("shift_id").eqNullSafe(right_shift)).alias("wrong_shift"),
        F.count_if(~F.col("category").eqNullSafe(right_category)).alias("wrong_category"))
    counts = duplicates.columns + wrong.columns
    report = duplicates.unionByName(wrong, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in counts]).withColumn(
        "repaired", F.col("duplicate_rows") + F.col("wrong_shift") + F.col("wrong_category")).withColumn(
        "status", F.when(F.col("repaired") > 0, "ISSUES").otherwise("OK"))
    return report, kept.withColumns({"shift_id": right_shift, "category": right_category})


def scheduled_exports(df: DataFrame, now: dt.datetime | str, last_shift: str | None = None,
                      last_day: dt.date | str | None = None, ts: str = "timestamp") -> DataFrame:
    """Exports due at `now`: `kind` (shift, day) and `export_key`.

    Every shift and day that is over counts from the first event on, also if it has no events itself.
    Nothing is due before there is any event.
    A last export that lies ahead of the last full day is taken back to it.
    """
    moment = dt.datetime.fromisoformat(now) if isinstance(now, str) else now
    today = dt.date(moment.year, moment.month, moment.day)
    current = (today - dt.date(1970, 1, 1)).days * 3 + moment.hour // 8
    span = df.agg(shift_order(F.min(ts).cast("date"), shift_id(F.min(ts))).alias("_first"))

    after_shift = -1
    if last_shift:
        day, _, number = last_shift.partition("-shift")
        after_shift = (dt.date.fromisoformat(day) - dt.date(1970, 1, 1)).days * 3 + int(number) - 1
        after_shift = min(after_shift, current - 1)
    after_day = -1
    if last_day:
        after_day = min((dt.date.fromisoformat(str(last_day)) - dt.date(1970, 1, 1)).days,
                        (today - dt.date(1970, 1, 1)).days - 1)

    def due(kind: str, first, last: int, after: int) -> DataFrame:
        start = F.greatest(first, F.lit(after + 1))
        return span.where(F.col("_first").isNotNull() & (start <= last)).select(
            F.lit(kind).alias("kind"), F.explode(F.sequence(start, F.lit(last))).alias("_n"))

    day, shift = shift_from_order(F.col("_n"))
    shifts = due("shift", F.col("_first"), current - 1, after_shift).select(
        "kind", shift_key(day, shift).alias("export_key"))
    last_full = (today - dt.date(1970, 1, 1)).days - 1
    days = due("day", F.floor(F.col("_first") / F.lit(3)).cast("int"), last_full, after_day).select(
        "kind", F.date_add(F.lit(dt.date(1970, 1, 1)), F.col("_n").cast("int")).cast("string").alias("export_key"))
    return shifts.unionByName(days)
