"""Jobs on stored tables: retention, upsert, collection, rules, sketches; shifts by local clocks; changes on a stream."""

from __future__ import annotations

import datetime as dt
import zoneinfo

import pytest
from pyspark.sql import functions as F

from daytrail.functions import timeparts
from daytrail.functions.timeparts import timestamp_lit
from daytrail.operators.sequence import changed_only
from daytrail.plans import reports
from daytrail.sources import collect, dated, tables
from daytrail.streaming import windows

AT = timestamp_lit("2026-06-01 00:00:00")
EVENT = "id LONG, user_id LONG, type STRING, app_name STRING, window_title STRING, url STRING, title STRING, timestamp TIMESTAMP_NTZ, duration_seconds INT"


def events(spark, times, user=1):
    rows = [(i, user, "app", f"a{i % 3}", "w", None, None, dt.datetime.fromisoformat(t) if t else None, 5) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, EVENT)


def mtimes(spark, path):
    return {f for files in dated.day_files(spark, path).values() for f in files}


# Retention

TIMES = ["2026-05-01 08:00:00", "2026-05-02 08:00:00", "2026-05-03 11:59:59", "2026-05-03 12:00:00", "2026-05-03 13:00:00", "2026-05-04 00:00:00", None]


def test_retention_rewrites_the_border_day_only(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.load_events(events(spark, TIMES), path, AT)
    before = mtimes(spark, path)
    [n] = dated.purge_table(spark, path, "timestamp", dated.USAGE_DDL, "2026-05-13 12:00:00", 10).first()
    assert n == 3 and sorted(r.id for r in tables.read_usage_events(spark, path).collect()) == [3, 4, 5, 6]
    kept = {f for f in before if "05-04" in f or "HIVE_DEFAULT" in f}
    assert kept < mtimes(spark, path) and set(dated.day_files(spark, path)) == {dt.date(2026, 5, 3), dt.date(2026, 5, 4), None}
    [n] = dated.purge_table(spark, path, "timestamp", dated.USAGE_DDL, "2026-05-13 12:00:00", 10).first()
    assert n == 0  # again


@pytest.mark.parametrize("cutoff, removed", [("2026-05-03 00:00:00", 2), ("2026-05-03 13:00:01", 5), ("2030-01-01 00:00:00", 6), ("2020-01-01 00:00:00", 0)])
def test_pruning_counts_what_goes_and_stays(spark, tmp_path, cutoff, removed):
    path = str(tmp_path / "t")
    tables.load_events(events(spark, TIMES), path, AT)
    done = dated.prune_table(spark, path, "timestamp", dated.USAGE_DDL, cutoff).first()
    assert (done.removed_events, done.remaining_events, done.last_shift_export_key) == (removed, 7 - removed, "")
    assert tables.read_usage_events(spark, path).count() == 7 - removed


def test_retention_of_no_table(spark, tmp_path):
    assert dated.prune_table(spark, str(tmp_path / "none"), "timestamp", dated.USAGE_DDL, "2026-01-01").first().remaining_events == 0


# Upsert

def test_a_stray_row_reads_one_more_day(spark, tmp_path):
    path = str(tmp_path / "t")
    days = [f"2026-04-{d:02d} 10:00:00" for d in range(1, 31)]
    tables.upsert_events(events(spark, days), path, AT)
    batch = tables.table_rows(events(spark, ["2026-04-02 10:00:00", "2026-04-29 10:00:00", "2026-04-29 11:00:00"]), AT)
    held = tables.touched_days(batch, tables.read_usage_events(spark, path))
    read = held.select(F.input_file_name().alias("f")).distinct().collect()
    assert sorted(r.f.split("event_date=")[1][:10] for r in read) == ["2026-04-02", "2026-04-29"]
    assert tables.touched_days(batch.limit(0), tables.read_usage_events(spark, path)).isEmpty()
    assert tables.touched_days(batch, tables.read_usage_events(spark, path), most=1).count() == 28  # more days than that are a range


# Collection

def log_rows(spark, times):
    rows = [(dt.datetime.fromisoformat(t), "APP", "p", "tool", "APP_USAGE", 5, "w", None, 1, f"k{t}") for t in times]
    return spark.createDataFrame(rows, dated.LOG_DDL)


def test_collection_keeps_its_progress(spark, tmp_path):
    path, progress = str(tmp_path / "t"), str(tmp_path / "p")
    first, more = ["2026-05-01 08:00:00", "2026-05-02 08:00:00"], ["2026-05-02 07:00:00", "2026-05-03 08:00:00"]

    def run(times, **given):
        r = collect.collect_log(log_rows(spark, times), path, progress, **given).first()
        return r.since and str(r.since), r.mark and str(r.mark), r.events_collected, r.events_written, dated.read_log(spark, path).count()

    assert run([]) == (None, None, 0, 0, 0) and collect.last_mark(spark, progress, "scheduled") is None
    assert run(first + first, dry_run=True) == (None, first[1], 2, 2, 0) and collect.last_mark(spark, progress, "scheduled") is None
    assert run(first + first) == (None, first[1], 2, 2, 2)
    assert run(first + more, dry_run=True) == (first[1], more[1], 1, 1, 2)
    assert run(first + more) == (first[1], more[1], 1, 1, 3)
    assert run(first + more) == (more[1], more[1], 0, 0, 3)
    # By hand, from a given time: what came late is found, what is there already is not stored again.
    assert run(first + more, kind="manual", since="2026-05-01 12:00:00") == ("2026-05-01 12:00:00", more[1], 3, 1, 4)
    assert str(collect.last_mark(spark, progress, "manual")) == more[1]
    collect.set_mark(spark, progress, "scheduled", "2026-06-01 00:00:00")
    assert str(collect.last_mark(spark, progress, "scheduled")) == "2026-06-01 00:00:00" != str(collect.last_mark(spark, progress, "manual"))


# Rules and drift

def test_broken_rules(spark):
    rows = tables.table_rows(events(spark, ["2026-05-01 10:00:00"] * 5), AT)
    assert tables.broken_rules(rows).isEmpty() and tables.broken_rules(rows.limit(0)).isEmpty()
    bad = rows.withColumns({"type": F.expr("CASE id WHEN 0 THEN NULL WHEN 1 THEN 'note' ELSE type END"), "duration_seconds": F.expr("IF(id = 2, 86401, duration_seconds)"),
                            "url": F.expr("IF(id = 3, repeat('u', 2001), url)")})
    assert {r.rule: r["rows"] for r in tables.broken_rules(bad).collect()} == {
        "type_not_null": 1, "type_known": 1, "duration_range": 1, "url_length": 1}
    by = tables.broken_rules(bad, by=[(F.col("id") % 2).alias("half")]).collect()
    assert {(r.half, r.rule) for r in by} == {(0, "type_not_null"), (1, "type_known"), (0, "duration_range"), (1, "url_length")}


def test_drifted_columns(spark):
    text = spark.createDataFrame([("1", "2026-01-01"), ("x", None), (None, "soon"), ("2.5", "2026-13-01")], "n STRING, d STRING")
    got = tables.drifted_columns(text, {"n": "long", "d": "date"}).collect()
    assert {(r.column_name, r.kind, r["rows"]) for r in got} == {("n", "long", 2), ("d", "date", 2)}


# Sketches

def test_ranges_from_stored_sketches(spark):
    df = spark.range(40_000).select(
        F.lit("web").alias("type"), F.concat(F.lit("a"), F.col("id") % 50).alias("app_name"), F.concat(F.lit("u"), F.col("id") % 9000).alias("url"),
        F.timestamp_add("MINUTE", F.col("id"), F.lit("2026-05-01").cast("timestamp_ntz")).alias("timestamp"))
    days = reports.daily_sketches(df)
    got = reports.range_summary(days, "2026-05-01", "2026-05-20").first()
    assert got.event_count == 20 * 1440 and abs(got.unique_apps - 50) <= 2
    assert abs(got.unique_urls - 9000) <= reports.SKETCH_ERROR * 9000
    assert reports.range_summary(days, "2027-01-01", "2027-02-01").isEmpty()


# Shifts by local clocks

@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Asia/Kolkata", "America/Havana", "UTC"])
def test_shifts_by_local_clocks(spark, zone):
    """Every half hour of a year, against the zone rules of Python; in Havana clocks change at midnight."""
    z, utc = zoneinfo.ZoneInfo(zone), dt.timezone.utc
    ts = F.timestamp_add("MINUTE", F.col("id") * 30, F.lit("2024-01-01").cast("timestamp_ntz"))
    df = spark.range(366 * 48).select(ts.alias("ts"))
    rows = df.select("ts", timeparts.timestamp_local(F.col("ts"), zone).alias("local"), timeparts.shift_day(F.col("ts"), zone).alias("day"),
                     timeparts.shift_id(F.col("ts"), zone).alias("shift"))
    rows = rows.withColumns({"start": timeparts.shift_start(F.col("day"), F.col("shift"), zone), "end": timeparts.shift_end(F.col("day"), F.col("shift"), zone)})
    lengths = set()
    for r in rows.collect():
        local = r.ts.replace(tzinfo=utc).astimezone(z)
        assert r.local == local.replace(tzinfo=None) and r.day == local.date() and r.shift == local.hour // 8 + 1
        assert r.start <= r.ts < r.end
        lengths.add((r.end - r.start).total_seconds() / 3600)
    assert lengths == ({8.0} if zone in ("Asia/Kolkata", "UTC") else {7.0, 8.0, 9.0})


# Changes on a stream

STREAM = "id LONG, user_id LONG, timestamp TIMESTAMP_NTZ, app_name STRING, window_title STRING"


def minutes(spark, rows):
    """Rows (id, user, minute, app)."""
    start = dt.datetime(2026, 5, 1)
    return spark.createDataFrame([(i, u, start + dt.timedelta(minutes=m), a, None) for i, u, m, a in rows], STREAM)


def run_changes(spark, tmp_path, **given):
    stream = windows.changed_only_stream(spark.readStream.schema(STREAM).parquet(str(tmp_path / "in")), "60 minutes", **given)
    query = windows.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    return query


def test_changes_go_on_after_a_restart(spark, tmp_path):
    """Three runs with one checkpoint: late rows within the watermark come in their place, a later one reaches no sink."""
    one = [(i, i % 2, i * 3, f"a{i // 7}") for i in range(60)]
    late = [(200, 0, 124, "late"), (201, 0, 125, "late")]  # no more than an hour behind the newest row, at minute 177
    two = [(300, 1, 200, "b"), (301, 1, 203, "b"), (302, 7, 204, None), (303, 7, 205, None), (304, None, 206, "x"), (305, None, 207, "x")]
    lost, end = [(400, 0, 5, "lost")], [(500, 9, 10_000, "end")]
    seen = []
    for part in (one, late + two, lost + end):
        minutes(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = run_changes(spark, tmp_path)
        seen.append(query.lastProgress)
    got = sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted(r.id for r in changed_only(minutes(spark, one + late + two)).collect())
    assert got == want and 201 not in got and 200 in got and 303 not in got
    assert sum(op.numRowsDroppedByWatermark for op in seen[-1].stateOperators) <= 1


def test_a_busy_key_sends_few_rows_to_its_state(spark, tmp_path):
    rows = [(i, 1, i % 500, "ab"[(i // 3) % 2]) for i in range(5000)] + [(9999, 2, 9000, "z")]
    minutes(spark, rows).coalesce(2).write.parquet(str(tmp_path / "in"))
    run_changes(spark, tmp_path, chunk="100 minutes")
    got = sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r.id for r in changed_only(minutes(spark, rows[:-1])).collect())


def test_changes_run_on_a_session_with_sparks_own_store(spark, tmp_path):
    """The store that keyed state needs is set for the query only, and a restart goes on with it."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    heap = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    one, two = [(i, 1, i, "ab"[i // 5 % 2]) for i in range(40)], [(50 + i, 1, 400 + i, "b") for i in range(5)]
    spark.conf.set(name, heap)
    try:
        for part in (one, two + [(99, 2, 9000, "end")]):
            minutes(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            run_changes(spark, tmp_path)
            assert spark.conf.get(name) == heap
    finally:
        spark.conf.set(name, before)
    got = sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r.id for r in changed_only(minutes(spark, one + two)).collect())
