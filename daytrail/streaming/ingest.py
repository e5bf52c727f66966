"""Continuous ingest: lines to events and rejects."""

from __future__ import annotations

import datetime as dt

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from daytrail.functions.timeparts import timestamp_lit
from daytrail.operators.delivery import STATUSES
from daytrail.operators.validation import (
    apply_load_defaults, normalize_web, redact_events, split_valid, validate_events)
from daytrail.schemas import EVENT_COLUMNS, OWNER_COLUMNS
from daytrail.sources.lines import stream_event_lines
from daytrail.sources.tables import upsert_events, write_rejects


def check_lines(lines: DataFrame, default_type: str | None = None) -> DataFrame:
    """Parsed lines with `reasons`; being malformed is the only one of a malformed line."""
    checked = validate_events(normalize_web(lines), default_type)
    return checked.withColumn("reasons", F.when(
        F.col("malformed"), F.array(F.lit("malformed_json"))).otherwise(F.col("reasons")))


def clean_lines(lines: DataFrame, ingest_time: Column, default_type: str | None = None
                ) -> tuple[DataFrame, DataFrame]:
    """(loadable events, rejects) of parsed lines; a malformed line is a reject."""
    valid, rejects = split_valid(check_lines(lines, default_type))
    return apply_load_defaults(redact_events(valid), ingest_time), rejects


def needed_fields(checked: DataFrame) -> DataFrame:
    """Of checked lines what is read later: the line of a reject, the event's fields of an accepted one."""
    if "raw_line" not in checked.columns:  # a reject then consists of all its fields
        return checked
    accepted = F.size("reasons") == 0
    fields = [c for c in [*OWNER_COLUMNS, *EVENT_COLUMNS] if c in checked.columns]
    return checked.select(F.when(~accepted, F.col("raw_line")).alias("raw_line"),
                          *[F.when(accepted, F.col(c)).alias(c) for c in fields], "reasons")


def ingest_batch(lines: DataFrame, events_path: str, batch_rejects_path: str, ingested_at: dt.datetime | str,
                 source: str = "stream", default_type: str | None = None) -> None:
    """Load one batch of parsed lines. The checked batch is read for events and for rejects, so it
    is kept while that lasts, on disk: a batch may be a whole folder, and what an executor keeps in
    memory of it would leave none for sorting and writing.

    Events are loaded by key and a batch's rejects replace those of its earlier try, so a batch
    that runs again after a failure repeats nothing.
    """
    moment = timestamp_lit(ingested_at)
    checked = needed_fields(check_lines(lines, default_type)).persist(StorageLevel.DISK_ONLY)
    try:
        valid, rejects = split_valid(checked)
        events = apply_load_defaults(redact_events(valid), moment)
        upsert_events(events, events_path, moment)
        write_rejects(rejects, batch_rejects_path, source, moment, mode="overwrite")
    finally:
        checked.unpersist()


def ingest_stream(spark: SparkSession, source: str, events_path: str, rejects_path: str, checkpoint: str,
                  ingested_at: dt.datetime | str | None = None, max_files: int | None = None,
                  every: str | None = None, default_type: str | None = None) -> StreamingQuery:
    """Feed of line files to the events table and the rejects.

    Runs until the folder is read, or with `every` (such as `10 seconds`) goes on. Without
    `ingested_at` each batch takes the time it starts at.
    """
    lines = stream_event_lines(spark, source, max_files)

    def load(batch: DataFrame, batch_id: int) -> None:
        now = ingested_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        ingest_batch(batch, events_path, f"{rejects_path}/batch={batch_id}", now, source, default_type)

    writer = lines.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def observed_counts(log: DataFrame, name: str = "ingest") -> DataFrame:
    """The frame with its rows per status as observed metrics, for a stream's progress."""
    return log.observe(name, *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
