"""Events of several users in one table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from daytrail.functions.timeparts import timestamp_lit
from daytrail.operators.sequence import sessionize
from daytrail.plans.reports import usage_export_rows
from daytrail.sources import tables

AT = "2026-04-26 10:00:00"
DDL = "id LONG, user_id LONG, type STRING, app_name STRING, window_title STRING, url STRING, title STRING, timestamp STRING, duration_seconds INT"


@pytest.fixture
def events(spark):
    """Two users' equal rows, a copy within a user, and a row without a user."""
    same = ("app", "a", "w", None, None, "2026-04-24 10:00:00", 5)
    rows = [(1, 1, *same), (2, 2, *same), (3, 1, *same), (4, None, *same)]
    return spark.createDataFrame(rows, DDL).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def owners(df):
    return sorted(((r.user_id or 0, r.id) for r in df.collect()))


def test_equal_rows_of_users_stay_apart(spark, events, tmp_path):
    path, archive, at = str(tmp_path / "t"), str(tmp_path / "a"), timestamp_lit(AT)
    tables.upsert_events(events.where("user_id = 1"), path, at)
    for _ in range(2):
        tables.upsert_events(events, path, at)
    table = tables.read_usage_events(spark, path)
    assert owners(table) == [(0, 4), (1, 1), (2, 2)]
    assert sorted(r.id for r in usage_export_rows(table, "app", AT).collect()) == [1, 2, 4]
    assert sessionize(table, 60).count() == 3
    tables.archive_week(spark, path, archive, "2026-04-20")
    tables.upsert_events(events.where("user_id = 2").withColumn("user_id", F.lit(5).cast("long")), path, at)
    tables.archive_week(spark, path, archive, "2026-04-20")
    assert owners(tables.read_usage_events(spark, archive + "/week=2026-04-20")) == [(0, 4), (1, 1), (2, 2), (5, 2)]


def test_load_keeps_owners(spark, events, tmp_path):
    tables.load_events(events, str(tmp_path / "t"), timestamp_lit(AT))
    assert owners(tables.read_usage_events(spark, str(tmp_path / "t"))) == [(0, 4), (1, 1), (1, 3), (2, 2)]
