"""Fact tables and the unified log as tables by day.

A table is a Parquet folder with one partition a day (`event_date`, the day of the table's time) and rows in order of time within
a file, so that a report of a day or a week opens the files of these days only, and a shift skips row groups within them. Rows
without a time are in a partition of their own. The filters of `operators.filters` give the day to the scan by themselves.

Appending leaves a few files a day each time; `compact_days` puts the files of such days together. A writer at a time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrail.functions.timeparts import date_lit, timestamp_lit
from daytrail.operators.lifecycle import RETENTION_DAYS
from daytrail.schemas import EVENTS_DDL, FACT_COLUMNS
from daytrail.session import scratch_dir
from daytrail.sources.tables import remove_path, table_exists

DAY_COLUMN = "event_date"
# The time that says which day a row belongs to.
FACT_TIMES = {"app_usage": "started_at", "website_visits": "visited_at", "website_usage": "started_at",
              "media_playback": "started_at", "media_track_change": "changed_at"}
USAGE_DDL = EVENTS_DDL.removesuffix(f", {DAY_COLUMN} DATE")  # of the events table, which is a table by day as well
LOG_DDL = ("timestamp TIMESTAMP_NTZ, category STRING, source STRING, item STRING, event_type STRING, duration_seconds LONG, "
           "window STRING, url STRING, shift_id INT, event_key STRING")


def fact_ddl(table: str) -> str:
    kinds = {"duration_seconds": "LONG"}
    return ", ".join(f"{c} {'TIMESTAMP_NTZ' if c.endswith('_at') else kinds.get(c, 'STRING')}" for c in FACT_COLUMNS[table])


def write_days(df: DataFrame, path: str, ts: str, mode: str = "append") -> None:
    """Add rows to a table by day. A large day is split over files, small ones share a task."""
    rows = df.withColumn(DAY_COLUMN, F.col(ts).cast("date"))
    rows.hint("rebalance", DAY_COLUMN).sortWithinPartitions(DAY_COLUMN, ts).write.mode(mode).partitionBy(DAY_COLUMN).parquet(path)


def read_days(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The table; one without a folder has no rows. No footer is read to plan a query."""
    if not table_exists(spark, path):
        return spark.createDataFrame([], f"{ddl}, {DAY_COLUMN} DATE")
    return spark.read.schema(f"{ddl}, {DAY_COLUMN} DATE").parquet(path)


def write_facts(facts: dict[str, DataFrame], path: str, mode: str = "append") -> None:
    for table, df in facts.items():
        schema = dict(part.split() for part in fact_ddl(table).split(", "))
        write_days(df.select(*[F.col(c).cast(schema[c]).alias(c) for c in FACT_COLUMNS[table]]), f"{path}/{table}", FACT_TIMES[table], mode)


def read_facts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {table: read_days(spark, f"{path}/{table}", fact_ddl(table)) for table in FACT_COLUMNS}


def write_log(df: DataFrame, path: str, mode: str = "append") -> None:
    """Add unified rows with their shift and key."""
    columns = [part.split() for part in LOG_DDL.split(", ")]
    write_days(df.select(*[F.col(c).cast(kind).alias(c) for c, kind in columns]), path, "timestamp", mode)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return read_days(spark, path, LOG_DDL)


def day_files(spark: SparkSession, path: str) -> dict[dt.date | None, list[str]]:
    """The files of each day of a table, by a listing of names; None has the rows without a time."""
    if not table_exists(spark, path):
        return {}
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[dt.date | None, list[str]] = {}
    for status in store.listStatus(root):
        folder = status.getPath()
        name, _, value = folder.getName().partition("=")
        if name == DAY_COLUMN and status.isDirectory():
            day = None if value == "__HIVE_DEFAULT_PARTITION__" else dt.date.fromisoformat(value)
            files = [f.getPath().toString() for f in store.listStatus(folder) if not f.getPath().getName().startswith(("_", "."))]
            out[day] = sorted(files)
    return out


def compact_days(spark: SparkSession, path: str, ts: str, ddl: str, most_files: int = 8, before: dt.date | str | None = None) -> list[dt.date]:
    """Put together the files of days that have more than `most_files`, of days before `before` if that is given; returns these days.

    The rows are written to the scratch folder first and replace the days from there, so that no row is only in a folder
    that is being replaced; a run that is cut off is run again. Rows without a time stay as they are.
    """
    until = dt.date.fromisoformat(str(before)) if before else dt.date.max
    days = sorted(d for d, files in day_files(spark, path).items() if d is not None and d < until and len(files) > most_files)
    if not days:
        return []
    copy = scratch_dir(spark, "compacted")
    rows = read_days(spark, path, ddl).where(F.col(DAY_COLUMN).isin(*[date_lit(d) for d in days]))
    try:
        write_days(rows.drop(DAY_COLUMN), copy, ts)
        again = read_days(spark, copy, ddl)
        again.hint("rebalance", DAY_COLUMN).sortWithinPartitions(DAY_COLUMN, ts).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(DAY_COLUMN).parquet(path)
    finally:
        remove_path(spark, copy)
    return days


def drop_before(spark: SparkSession, path: str, ts: str, ddl: str, cutoff: dt.datetime | str) -> tuple[int, int]:
    """Remove a table's rows from before the cutoff; returns (rows removed, rows left). Rows without a time stay.

    Days before the cutoff's go as folders, and their rows are counted from the files' footers; so are the rows of days that stay.
    Only the day the cutoff falls into is read and written again. A run that is cut off is finished by the next one.
    """
    moment = dt.datetime.fromisoformat(cutoff) if isinstance(cutoff, str) else cutoff
    files = day_files(spark, path)
    old = [d for d in files if d is not None and d < moment.date()]
    border = moment.date() if moment.time() != dt.time() and moment.date() in files else None
    counts = _day_counts(spark, path, ddl) if files else {}
    removed = sum(n for d, n in counts.items() if d in old)
    left = sum(n for d, n in counts.items() if d not in old and (d is None or d != border))
    if border:
        day = read_days(spark, path, ddl).where(F.col(DAY_COLUMN) == date_lit(border))
        kept = F.count_if(F.coalesce(F.col(ts) >= timestamp_lit(moment), F.lit(True)))
        all_rows, stay = day.agg(F.count("*"), kept).first()
        removed, left = removed + all_rows - stay, left + stay
        if not stay:
            remove_path(spark, f"{path}/{DAY_COLUMN}={border}")
        elif stay < all_rows:
            copy = scratch_dir(spark, "border")
            try:
                write_days(day.where(F.col(ts) >= timestamp_lit(moment)).drop(DAY_COLUMN), copy, ts)
                read_days(spark, copy, ddl).sortWithinPartitions(ts).write.mode("overwrite").option(
                    "partitionOverwriteMode", "dynamic").partitionBy(DAY_COLUMN).parquet(path)
            finally:
                remove_path(spark, copy)
    for day in old:
        remove_path(spark, f"{path}/{DAY_COLUMN}={day}")
    return removed, left


def _day_counts(spark: SparkSession, path: str, ddl: str) -> dict[dt.date | None, int]:
    """Rows of each day. No column of the files is read, so their footers tell."""
    return {r[0]: r[1] for r in read_days(spark, path, ddl).groupBy(DAY_COLUMN).count().collect()}


def purge_table(spark: SparkSession, path: str, ts: str, ddl: str, as_of: dt.datetime | str, days: int = RETENTION_DAYS) -> DataFrame:
    """Retention as a job: one row with `rows_deleted`. The exact cutoff stays."""
    moment = dt.datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    removed, _ = drop_before(spark, path, ts, ddl, moment - dt.timedelta(days=days))
    return spark.createDataFrame([(removed,)], "rows_deleted LONG")


def prune_table(spark: SparkSession, path: str, ts: str, ddl: str, cutoff: dt.datetime | str) -> DataFrame:
    """Pruning as a job: one summary row; the export state starts anew."""
    removed, left = drop_before(spark, path, ts, ddl, cutoff)
    return spark.createDataFrame([(removed, left, "", "")], "removed_events LONG, remaining_events LONG, last_shift_export_key STRING, last_daily_export_date STRING")


def row_groups_in_order(spark: SparkSession, files: Sequence[str], ts: str) -> bool:
    """Whether no file has a row behind a later one, which is what lets a scan skip row groups."""
    rows = spark.read.parquet(*files).select(F.col(ts).alias("_ts"), "_metadata.file_path", "_metadata.row_index")
    block = F.floor(F.col("row_index") / 10_000)  # neighbours within a block; blocks by their bounds
    bounds = rows.groupBy("file_path", block.alias("_b")).agg(F.min("_ts").alias("_first"), F.max("_ts").alias("_last"))
    nxt = bounds.select("file_path", (F.col("_b") - 1).alias("_b"), F.col("_first").alias("_next"))
    return bounds.join(nxt, ["file_path", "_b"]).where("_next < _last").isEmpty()
