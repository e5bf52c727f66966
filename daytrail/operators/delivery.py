"""Delivery log: statistics, selection, retries and clean-up.

Rows: id, payload, status, retry_count, created_at, updated_at, next_retry_at, error_message.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrail.functions.timeparts import timestamp_lit

# Statuses, thresholds and retry limits.
STATUSES = ["pending", "processing", "failed", "completed"]
MODERATE_BACKLOG = 50_000
SEVERE_BACKLOG = 100_000
MAX_LOG_SIZE = 1_000_000
MAX_RETRIES = 5
FIRST_DELAY_SECONDS = 2
MAX_DELAY_SECONDS = 300
RETRIES_EXCEEDED = f"Max retries ({MAX_RETRIES}) exceeded"


def _us_before(now: dt.datetime | str, **delta: int) -> Column:
    moment = dt.datetime.fromisoformat(now) if isinstance(now, str) else now
    return timestamp_lit(moment - dt.timedelta(**delta))


def delivery_status_counts(log: DataFrame) -> DataFrame:
    """One row: rows per status, 0 where there is none, and in total."""
    return log.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("total"))


def backlog_level(log: DataFrame, moderate: int = MODERATE_BACKLOG, severe: int = SEVERE_BACKLOG
                  ) -> DataFrame:
    """One row: pending rows, whether to slow down, and how bad it is."""
    pending = log.agg(F.count_if(F.col("status") == "pending").alias("pending"))
    return pending.select(
        "pending", (F.col("pending") > moderate).alias("backpressure_needed"),
        F.when(F.col("pending") > severe, "severe").when(F.col("pending") > moderate, "moderate")
        .otherwise("none").alias("level"))


def pipeline_health(log: DataFrame, max_size: int = MAX_LOG_SIZE, warning_size: int = SEVERE_BACKLOG,
                    moderate: int = MODERATE_BACKLOG, severe: int = SEVERE_BACKLOG) -> DataFrame:
    """One row: size, state of the log and its alerts, from one pass."""
    counts = delivery_status_counts(log)
    size, pending, failed = F.col("total"), F.col("pending"), F.col("failed")
    state = F.when(size < warning_size, "ok").when(size < max_size, "warning").otherwise("critical")
    alerts = F.filter(F.array(
        F.when(pending > severe, "severe_backlog").when(pending > moderate, "moderate_backlog"),
        F.when(size >= max_size, "log_full"),
        F.when(failed > 0, "failed_rows"),
    ), lambda a: a.isNotNull())
    return counts.select(size.alias("size"), "pending", "failed", state.alias("state"),
                         F.concat_ws(",", alerts).alias("alerts"))


def ingest_metrics(batch: DataFrame) -> DataFrame:
    """One row: processed, failed and retried rows of a batch, and its app and web rows."""
    kind = F.get_json_object(F.when(F.try_parse_json("payload").isNotNull(), F.col("payload")), "$.type")
    return batch.agg(
        F.count_if(F.col("status") == "completed").alias("processed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if((F.col("status") == "pending") & (F.col("retry_count") > 0)).alias("retried"),
        F.count_if(kind == "app").alias("app_rows"),
        F.count_if(kind == "web").alias("web_rows"))


def due_batch(log: DataFrame, now: dt.datetime | str, n: int = 10) -> DataFrame:
    """Oldest pending rows that may be tried now."""
    due = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= timestamp_lit(now))
    return log.where((F.col("status") == "pending") & due).orderBy("created_at", "id").limit(n)


def cleanup_completed(log: DataFrame, as_of: dt.datetime | str, days: int = 30) -> DataFrame:
    """The log without completed rows last touched before the cutoff."""
    old = (F.col("status") == "completed") & (F.col("updated_at") < _us_before(as_of, days=days))
    return log.where(~F.coalesce(old, F.lit(False)))


def recover_stale(log: DataFrame, now: dt.datetime | str, minutes: int = 5) -> DataFrame:
    """Rows left in processing too long become pending again."""
    stale = (F.col("status") == "processing") & (F.col("updated_at") < _us_before(now, minutes=minutes))
    return log.withColumns({
        "status": F.when(stale, "pending").otherwise(F.col("status")),
        "updated_at": F.when(stale, timestamp_lit(now)).otherwise(F.col("updated_at")),
    })


def schedule_retries(failures: DataFrame, now: dt.datetime | str) -> DataFrame:
    """Next try of failed deliveries, later each time; after the last one they are failed."""
    tries = F.col("retry_count") + 1
    over = tries >= MAX_RETRIES
    delay = F.least(F.lit(FIRST_DELAY_SECONDS) * F.pow(F.lit(2), F.col("retry_count")),
                    F.lit(MAX_DELAY_SECONDS))
    moment = timestamp_lit(now)
    return failures.withColumns({
        "status": F.when(over, "failed").otherwise("pending"),
        "retry_count": F.when(over, F.col("retry_count")).otherwise(tries),
        "updated_at": moment,
        "next_retry_at": F.when(over, F.col("next_retry_at")).otherwise(
            F.timestamp_add("SECOND", delay.cast("int"), moment)),
        "error_message": F.when(over, F.lit(RETRIES_EXCEEDED)).otherwise(F.col("error_message")),
    })


def apply_outcomes(log: DataFrame, outcomes: DataFrame, now: dt.datetime | str) -> DataFrame:
    """The log with the status each tried row ended in. `outcomes`: id, outcome, message and perhaps `at`.

    Of several outcomes of an id the last by `at` counts; without times, the greatest by name and message.
    """
    order = F.struct(*[c for c in ("at", "outcome", "message") if c in outcomes.columns])
    last = outcomes.groupBy("id").agg(F.max_by(F.struct("outcome", "message"), order).alias("_last"))
    tried = log.join(last.select("id", "_last.*"), "id", "left")
    done = F.col("outcome").isNotNull()
    return tried.withColumns({
        "status": F.coalesce("outcome", "status"),
        "updated_at": F.when(done, timestamp_lit(now)).otherwise(F.col("updated_at")),
        "error_message": F.when(F.col("outcome") == "failed", F.col("message"))
        .otherwise(F.col("error_message")),
    }).drop("outcome", "message")


def quarantine_bad_json(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a JSON payload, the others)."""
    bad = F.try_parse_json("payload").isNull()
    return log.where(~bad), log.where(bad)
