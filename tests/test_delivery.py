from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from daytrail.operators import delivery
from daytrail.plans import reports

NOW = datetime(2026, 4, 24, 12, 0)


@pytest.fixture
def log(spark):
    def run(*rows):
        """Rows of status, retries, minutes since the last update, payload, next try in minutes."""
        full = [(i, p, s, r, NOW - timedelta(days=2), NOW - timedelta(minutes=m), None if n is None else NOW + timedelta(minutes=n), None)
                for i, (s, r, m, p, n) in enumerate(rows)]
        return spark.createDataFrame(full, "id LONG, payload STRING, status STRING, retry_count INT, created_at TIMESTAMP_NTZ, "
                                           "updated_at TIMESTAMP_NTZ, next_retry_at TIMESTAMP_NTZ, error_message STRING")

    return run


def row(status="pending", retries=0, minutes=0, payload="{}", next_try=None):
    return status, retries, minutes, payload, next_try


def test_status_counts_are_zero_filled(log):
    assert delivery.delivery_status_counts(log(row(), row("failed"))).first().asDict() == {
        "pending": 1, "processing": 0, "failed": 1, "completed": 0, "total": 2}
    assert delivery.delivery_status_counts(log(row()).limit(0)).first().total == 0


@pytest.mark.parametrize("moderate,severe,level,needed", [(2, 4, "moderate", True), (1, 2, "severe", True), (3, 4, "none", False)])
def test_backlog(log, moderate, severe, level, needed):
    r = delivery.backlog_level(log(row(), row(), row(), row("failed")), moderate, severe).first()
    assert (r.level, r.backpressure_needed) == (level, needed)


def test_health(log):
    df = log(row(), row("failed"))
    assert delivery.pipeline_health(df).first().state == "ok"
    assert delivery.pipeline_health(df, max_size=3, warning_size=2).first().state == "warning"
    r = delivery.pipeline_health(df, max_size=2, warning_size=1).first()
    assert (r.state, r.alerts) == ("critical", "log_full,failed_rows")


def test_due_batch_takes_pending_rows_only(log):
    df = log(row(), row("processing"), row(next_try=-1), row(next_try=5), row(next_try=0))
    assert [r.id for r in delivery.due_batch(df, NOW).collect()] == [0, 2, 4]
    assert [r.id for r in delivery.due_batch(df, NOW, 1).collect()] == [0]


def test_stale_rows_recover(log):
    got = delivery.recover_stale(log(row("processing", minutes=10), row("processing", minutes=5), row("failed", minutes=10)), NOW).orderBy("id").collect()
    assert [r.status for r in got] == ["pending", "processing", "failed"] and got[0].updated_at == NOW


def test_retries(log):
    got = delivery.schedule_retries(log(*[row("processing", r) for r in (0, 1, 3, 4, 9)]), NOW).orderBy("id").collect()
    assert [(r.status, r.retry_count) for r in got] == [("pending", 1), ("pending", 2), ("pending", 4), ("failed", 4), ("failed", 9)]
    assert [(r.next_retry_at - NOW).seconds for r in got[:3]] == [2, 4, 16]
    assert got[3].error_message == "Max retries (5) exceeded"


def test_cleanup_drops_old_completed_rows_only(log):
    month = 31 * 24 * 60
    got = delivery.cleanup_completed(log(row("completed", minutes=month), row("failed", minutes=month), row("completed", minutes=60)), NOW)
    assert sorted(r.id for r in got.collect()) == [1, 2]


def test_outcomes(log, spark):
    outcomes = spark.createDataFrame([(0, "completed", None), (1, "failed", "bad url")], "id LONG, outcome STRING, message STRING")
    got = delivery.apply_outcomes(log(row("processing", minutes=1), row("processing", minutes=1), row("pending", minutes=1)), outcomes, NOW).orderBy("id").collect()
    assert [(r.status, r.error_message, r.updated_at == NOW) for r in got] == [
        ("completed", None, True), ("failed", "bad url", True), ("pending", None, False)]


def test_bad_json_is_quarantined(log):
    good, bad = delivery.quarantine_bad_json(log(row(payload='{"a":1}'), row(payload="{"), row(payload=""), row(payload="[]")))
    assert sorted(r.id for r in good.collect()) == [0, 3] and sorted(r.id for r in bad.collect()) == [1, 2]


def test_latency_picks_the_value_at_the_index(spark):
    values = [float(v) for v in (5, 1, 4, 2, 3, 0, -1, 10, 7, 8, 6, 9, 1000, 0.001)]
    df = spark.createDataFrame([("a", v, NOW + timedelta(seconds=i), v > 9) for i, v in enumerate(values)] + [("b", 2.0, NOW, False)],
                               "g STRING, v DOUBLE, t TIMESTAMP_NTZ, e BOOLEAN")
    got = {r.group_key: r for r in reports.latency_stats(df, "v", "t", "g", "e").collect()}
    ordered = sorted(values)
    want = tuple(ordered[int(len(values) * p)] for p in (0.5, 0.95, 0.99))
    assert (got["a"].p50, got["a"].p95, got["a"].p99) == want
    assert (got["a"].operations, got["a"].max_value, got["a"].error_count, got["a"].total_seconds) == (14, 1000.0, 2, 13.0)
    assert (got["b"].p50, got["b"].p99) == (2.0, 2.0)


def test_approximate_daily_summary(spark, small):
    from checks.bindings import AS_OF, bind

    events = bind(spark, small, "usage_events")
    exact = {(r.date, r.type): r for r in reports.daily_summary(events, AS_OF).collect()}
    for r in reports.daily_summary(events, AS_OF, approx=True).collect():
        assert r.event_count == exact[r.date, r.type].event_count
        assert abs(r.unique_urls - exact[r.date, r.type].unique_urls) <= 3
