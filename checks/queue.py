"""Delivery log."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import NOW, bind
from checks.registry import query
from daytrail.operators import delivery

LOG = ("delivery_log",)
_AT = f"TIMESTAMP '{NOW}'"


@query("delivery_status_counts", needs=LOG, sql="""
SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'completed') AS completed, count(*) AS total FROM delivery_log""")
def _(spark, sf):
    return delivery.delivery_status_counts(bind(spark, sf, "delivery_log"))


@query("backlog_level", needs=LOG, sql="""
SELECT pending, pending > 1000 AS backpressure_needed,
  CASE WHEN pending > 3000 THEN 'severe' WHEN pending > 1000 THEN 'moderate' ELSE 'none' END AS level
FROM (SELECT count(*) AS pending FROM delivery_log WHERE status = 'pending')""")
def _(spark, sf):
    return delivery.backlog_level(bind(spark, sf, "delivery_log"), 1000, 3000)


@query("pipeline_health", needs=LOG, sql="""
SELECT size, pending, failed, CASE WHEN size < 100000 THEN 'ok' WHEN size < 1000000 THEN 'warning' ELSE 'critical' END AS state,
  array_to_string(list_filter([CASE WHEN pending > 100000 THEN 'severe_backlog' WHEN pending > 1000 THEN 'moderate_backlog' END,
    CASE WHEN size >= 1000000 THEN 'log_full' END, CASE WHEN failed > 0 THEN 'failed_rows' END], lambda a: a IS NOT NULL), ',') AS alerts
FROM (SELECT count(*) AS size, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed FROM delivery_log)""")
def _(spark, sf):
    return delivery.pipeline_health(bind(spark, sf, "delivery_log"), moderate=1000)


@query("ingest_metrics", needs=LOG, sql="""
SELECT count(*) FILTER (status = 'completed') AS processed, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'pending' AND retry_count > 0) AS retried,
  count(*) FILTER (json_valid(payload) AND payload LIKE '%"app"%') AS app_rows,
  count(*) FILTER (json_valid(payload) AND payload LIKE '%"web"%') AS web_rows FROM delivery_log""")
def _(spark, sf):
    return delivery.ingest_metrics(bind(spark, sf, "delivery_log"))


@query("due_batch", needs=LOG, sql=f"""
SELECT * FROM delivery_log WHERE status = 'pending' AND (next_retry_at IS NULL OR next_retry_at <= {_AT} - INTERVAL 1 YEAR)
ORDER BY created_at, id LIMIT 10""")
def _(spark, sf):
    return delivery.due_batch(bind(spark, sf, "delivery_log"), "2000-08-02 00:00:00")


@query("cleanup_completed", needs=LOG, sql=f"""
SELECT * FROM delivery_log WHERE NOT (status = 'completed' AND updated_at < {_AT} - INTERVAL 30 DAY)""")
def _(spark, sf):
    return delivery.cleanup_completed(bind(spark, sf, "delivery_log"), NOW)


@query("recover_stale", needs=LOG, sql=f"""
SELECT * EXCLUDE (stale) REPLACE (CASE WHEN stale THEN 'pending' ELSE status END AS status, CASE WHEN stale THEN {_AT} ELSE updated_at END AS updated_at)
FROM (SELECT *, status = 'processing' AND updated_at < {_AT} - INTERVAL 5 MINUTE AS stale FROM delivery_log)""")
def _(spark, sf):
    return delivery.recover_stale(bind(spark, sf, "delivery_log"), NOW)


@query("schedule_retries", needs=LOG, sql=f"""
SELECT id, payload, CASE WHEN retry_count >= 4 THEN 'failed' ELSE 'pending' END AS status,
  CASE WHEN retry_count >= 4 THEN retry_count ELSE retry_count + 1 END AS retry_count, created_at, {_AT} AS updated_at,
  CASE WHEN retry_count >= 4 THEN next_retry_at ELSE {_AT} + CAST(least(2 * power(2, retry_count), 300) AS INT) * INTERVAL '1' SECOND END AS next_retry_at,
  CASE WHEN retry_count >= 4 THEN 'Max retries (5) exceeded' ELSE error_message END AS error_message
FROM delivery_log WHERE status = 'failed'""")
def _(spark, sf):
    return delivery.schedule_retries(bind(spark, sf, "delivery_log").where("status = 'failed'"), NOW)


@query("apply_outcomes", needs=LOG, sql=f"""
SELECT * EXCLUDE (o) REPLACE (coalesce(o, status) AS status, CASE WHEN o IS NOT NULL THEN {_AT} ELSE updated_at END AS updated_at,
  CASE WHEN o = 'failed' THEN 'rejected' ELSE error_message END AS error_message)
FROM (SELECT *, CASE WHEN status = 'processing' THEN CASE WHEN retry_count = 0 THEN 'failed' ELSE 'completed' END END AS o FROM delivery_log)""")
def _(spark, sf):
    log = bind(spark, sf, "delivery_log")
    outcomes = log.where("status = 'processing'").select(
        "id", F.when(F.col("retry_count") == 0, "failed").otherwise("completed").alias("outcome"),
        F.lit("rejected").alias("message"))
    return delivery.apply_outcomes(log, outcomes, NOW)


@query("quarantine_bad_json", needs=LOG, sql="""
SELECT id, CASE WHEN json_valid(payload) THEN 'good' ELSE 'bad' END AS outcome FROM delivery_log""")
def _(spark, sf):
    good, bad = delivery.quarantine_bad_json(bind(spark, sf, "delivery_log"))
    return good.select("id", F.lit("good").alias("outcome")).unionByName(
        bad.select("id", F.lit("bad").alias("outcome")))
