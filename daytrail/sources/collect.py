"""Collection of new log rows into the table as a job that keeps its progress.

Progress is an append-only table of marks: a run that is over adds the newest time it has seen, so a run that is cut off adds none and is
simply run again; rows are told apart by key, so that nothing is stored twice. Scheduled and manual runs have marks of their own, and a
manual run does not move the scheduled one.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrail.functions.timeparts import timestamp_lit
from daytrail.operators.sequence import dedupe_events
from daytrail.session import scratch_dir
from daytrail.sources.dated import DAY_COLUMN, read_log, write_log
from daytrail.sources.tables import remove_path, table_exists

MARKS_DDL = "kind STRING, mark TIMESTAMP_NTZ, events_collected LONG, events_written LONG"
RESULT_DDL = "kind STRING, since TIMESTAMP_NTZ, mark TIMESTAMP_NTZ, events_collected LONG, events_written LONG, dry_run BOOLEAN"


def last_mark(spark: SparkSession, progress: str, kind: str) -> dt.datetime | None:
    """Newest time that a run of this kind has collected up to."""
    if not table_exists(spark, progress):
        return None
    return spark.read.schema(MARKS_DDL).parquet(progress).where(F.col("kind") == kind).agg(F.max("mark")).first()[0]


def set_mark(spark: SparkSession, progress: str, kind: str, mark: dt.datetime | str, collected: int = 0, written: int = 0) -> None:
    moment = dt.datetime.fromisoformat(mark) if isinstance(mark, str) else mark
    spark.createDataFrame([(kind, moment, collected, written)], MARKS_DDL).coalesce(1).write.mode("append").parquet(progress)


def collect_log(log: DataFrame, path: str, progress: str, kind: str = "scheduled", since: dt.datetime | str | None = None,
                dry_run: bool = False) -> DataFrame:
    """Load the log rows newer than `since`, else than the kind's last mark; one row that says what was done.

    `events_collected` are the distinct events found, also those the table has already; `events_written` those it lacked. A dry
    run counts both in one pass and writes nothing, no mark either. The mark moves with data only.
    """
    spark = log.sparkSession
    start = since if since is not None else last_mark(spark, progress, kind)
    start = dt.datetime.fromisoformat(start) if isinstance(start, str) else start
    new = log if start is None else log.where(F.col("timestamp") > timestamp_lit(start))
    known = read_log(spark, path)
    if start is not None:  # an event has one time, so days before `since` cannot have it
        known = known.where(F.col(DAY_COLUMN) >= timestamp_lit(start).cast("date"))
    once = dedupe_events(new, ["event_key"], ["timestamp"])
    told = once.join(known.select("event_key", F.lit(True).alias("_known")).distinct(), "event_key", "left")
    counts = [F.count(F.lit(1)), F.count_if(F.col("_known").isNull()), F.max("timestamp")]
    if dry_run:
        collected, written, mark = told.agg(*counts).first()
    else:
        increment = scratch_dir(spark, "increment")
        try:  # what is counted is what is written, whatever the log gets meanwhile
            told.write.parquet(increment)
            told = spark.read.schema(told.schema).parquet(increment)
            collected, written, mark = told.agg(*counts).first()
            if written:
                write_log(told.where("_known IS NULL"), path)
        finally:
            remove_path(spark, increment)
    mark = mark or start
    if not dry_run and mark is not None:
        set_mark(spark, progress, kind, mark, collected, written)
    return spark.createDataFrame([(kind, start, mark, collected, written, dry_run)], RESULT_DDL)
