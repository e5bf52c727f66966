"""CSV exports and fact files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrail.functions.timeparts import log_timestamp, parse_event_ts, readable_duration, shift_id
from daytrail.operators.unified import daily_rows
from daytrail.operators.validation import whole_number
from daytrail.plans.reports import usage_export_rows
from daytrail.schemas import DAILY_CSV_COLUMNS, FACT_COLUMNS
from daytrail.sources.tables import table_exists

CSV = {"header": "true", "escape": '"', "emptyValue": ""}
READ_CSV = CSV | {"multiLine": "true"}  # a title may hold line breaks


def _clock_text(ts: Column) -> Column:
    """`2024-01-01 10:00:00`, with microseconds only where there are any."""
    return F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise(
        log_timestamp(ts))


def export_usage_csv(df: DataFrame, kind: str, as_of: dt.datetime | str, out: str,
                     retention_days: int = 90) -> bool:
    """Write `out/<kind>_usage/export_date=<day>` as gzip CSV parts, newest first; False and no
    file when there are no rows. Part files follow each other in time order."""
    rows = usage_export_rows(df, kind, as_of, retention_days)
    if rows.isEmpty():
        return False
    day = dt.datetime.fromisoformat(as_of).date() if isinstance(as_of, str) else as_of.date()
    ordered = rows.orderBy(F.col("timestamp").desc(), F.col("id").desc())
    ordered.withColumn("timestamp", _clock_text(F.col("timestamp"))).write.mode("overwrite").options(
        **CSV, compression="gzip", lineSep="\n").csv(f"{out}/{kind}_usage/export_date={day.isoformat()}")
    return True


def read_fact_logs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Fact tables of a folder with one CSV file or folder per table; times and durations parsed.

    A table without a file has no rows.
    """
    def read(table: str, columns: list[str]) -> DataFrame:
        schema, file = ", ".join(f"{c} STRING" for c in columns), f"{path}/{table}.csv"
        if not table_exists(spark, file):
            return spark.createDataFrame([], schema)
        return spark.read.options(**READ_CSV).schema(schema).csv(file)

    return {table: typed_facts(read(table, columns)) for table, columns in FACT_COLUMNS.items()}


def typed_facts(df: DataFrame) -> DataFrame:
    """Text columns of a fact file as timestamps and whole numbers."""
    return df.select(*[
        parse_event_ts(F.col(c)).alias(c) if c.endswith("_at")
        else whole_number(F.col(c)).alias(c) if c == "duration_seconds" else F.col(c)
        for c in df.columns])


def write_fact_logs(facts: dict[str, DataFrame], path: str, mode: str = "append") -> None:
    for table, df in facts.items():
        text = [log_timestamp(F.col(c)).alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes]
        df.select(*text).write.mode(mode).options(**CSV).csv(f"{path}/{table}.csv")


def export_daily_csv(df: DataFrame, day: dt.date | str, out: str) -> None:
    daily_rows(df, day).orderBy("timestamp").write.mode("overwrite").options(**CSV).csv(f"{out}/date={day}")


def export_shift_csv(df: DataFrame, day: dt.date | str, shift: int, out: str) -> None:
    daily_rows(df, day, shift).orderBy("timestamp").write.mode("overwrite").options(**CSV).csv(
        f"{out}/date={day}/shift_id={shift}")


def export_all_days(df: DataFrame, out: str) -> None:
    """Every day's and shift's CSV rows in one job, as `date=/shift_id=` folders."""
    rows = df.select(
        F.col("timestamp").cast("date").alias("date"), shift_id(F.col("timestamp")).alias("shift_id"),
        log_timestamp(F.col("timestamp")).alias("timestamp"), "category", "item", "duration_seconds",
        readable_duration(F.col("duration_seconds")).alias("duration_readable"), "source", "event_type",
        "window", "url")
    rows.hint("rebalance", "date", "shift_id").sortWithinPartitions("date", "shift_id", "timestamp").write.mode("overwrite").partitionBy(
        "date", "shift_id").options(**CSV).csv(out)


def read_daily_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily CSV rows as text, one file or a folder of days."""
    return spark.read.options(**READ_CSV).option("recursiveFileLookup", "true").schema(
        ", ".join(f"{c} STRING" for c in DAILY_CSV_COLUMNS)).csv(path)
