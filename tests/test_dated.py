"""Fact tables and the unified log by day: pruned reads, compaction, odd rows; reports on them."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from daytrail.functions.timeparts import timestamp_lit
from daytrail.plans import daily
from daytrail.sources import archive, dated, lines, tables
from daytrail.streaming.ingest import ingest_batch

DAYS = [dt.date(2026, 5, d) for d in range(1, 8)]


@pytest.fixture(scope="module")
def facts(spark):
    """A row an hour for a week in each table, copies among them, and one row without a time."""
    hours = spark.range(7 * 24).select(
        (F.lit("2026-05-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("at"), "id")
    end = F.col("at") + F.expr("INTERVAL '10' MINUTE")
    spans = hours.select(F.col("at").alias("logged_at"), F.col("at").alias("started_at"), end.alias("ended_at"), F.lit(600).cast("long").alias("duration_seconds"), "id")
    app = spans.select("logged_at", "started_at", "ended_at", "duration_seconds", F.lit("p").alias("process_name"),
                       F.concat(F.lit("tool "), F.col("id") % 3).alias("app_name"), F.lit("w").alias("window_title"))
    site = spans.select("logged_at", "started_at", "ended_at", "duration_seconds", F.lit("b").alias("browser"), F.lit("x.org").alias("domain"),
                        F.lit("https://x.org/").alias("url"), F.lit("t").alias("page_title"), F.lit("s").alias("source"))
    visits = hours.select(F.col("at").alias("logged_at"), F.col("at").alias("visited_at"), F.lit("b").alias("browser"), F.lit("x.org").alias("domain"),
                          F.concat(F.lit("https://x.org/"), F.col("id") % 2).alias("url"), F.lit("t").alias("page_title"), F.lit("s").alias("source"))
    media = spans.select("logged_at", "started_at", "ended_at", "duration_seconds", F.concat(F.lit("player "), F.col("id") % 2).alias("source_app"),
                         F.lit("Slow Air").alias("title"), F.lit("Quartet").alias("artist"), F.lit("playing").alias("playback_state"))
    change = hours.select(F.col("at").alias("logged_at"), F.col("at").alias("changed_at"), F.lit("p").alias("source_app"), F.lit("t").alias("title"),
                          F.lit("a").alias("artist"), F.lit("playing").alias("playback_state"))
    timeless = app.limit(1).withColumn("started_at", F.lit(None).cast("timestamp_ntz"))
    return {"app_usage": app.unionByName(app.where("app_name = 'tool 0'")).unionByName(timeless), "website_usage": site,
            "website_visits": visits, "media_playback": media, "media_track_change": change}


@pytest.fixture
def store(spark, facts, tmp_path):
    dated.write_facts(facts, str(tmp_path / "facts"))
    return str(tmp_path / "facts")


def rows(df, *columns):
    return sorted(map(repr, df.select(*columns).collect())) if columns else sorted(map(repr, df.collect()))


REPORTS = [("app_time", "app_usage"), ("count_app_sessions", "app_usage"), ("website_time", "website_usage"),
           ("website_details", "website_visits"), ("media_time", "media_playback"), ("daily_searches", "website_visits")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, table", REPORTS)
def test_a_day_opens_its_partition_only(spark, facts, store, name, table):
    report = getattr(daily, name)
    found = report(dated.read_facts(spark, store)[table], DAYS[2])
    assert "PartitionFilters: [isnotnull(event_date" in plan_of(found) and "= 2026-05-03" in plan_of(found)
    assert rows(found) == rows(report(facts[table], DAYS[2]))


def test_a_day_reads_its_files_only(spark, store):
    apps = dated.read_facts(spark, store)["app_usage"]
    assert {f.split("event_date=")[1][:10] for f in apps.where("event_date = DATE'2026-05-03'").inputFiles()} >= {"2026-05-03"}
    read = apps.where("event_date = DATE'2026-05-03'").select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("event_date=")[1][:10] for r in read} == {"2026-05-03"}


@pytest.mark.parametrize("report", [daily.productivity_score, daily.productivity_insights])
def test_scores_agree_with_unpartitioned_facts(spark, facts, store, report):
    rules = daily.default_rules(spark)
    assert rows(report(dated.read_facts(spark, store), DAYS[1], rules)) == rows(report(facts, DAYS[1], rules))


def test_a_rule_for_a_track_classes_it_alike_by_day_and_week(spark, facts, store):
    rules = spark.createDataFrame([("media", "slow air - quartet", "productive"), ("app", "tool 1", "unproductive")], "kind STRING, name STRING, activity STRING")
    held = dated.read_facts(spark, store)
    only = {**held, "app_usage": held["app_usage"].limit(0), "website_usage": held["website_usage"].limit(0)}
    assert daily.productivity_score(only, DAYS[1], rules).first().score == 100.0
    week = {(r.metric, r.key): r.value for r in daily.weekly_report(only, DAYS[0], rules).collect()}
    assert week == {("media_seconds", "player 0 | Slow Air - Quartet"): 84 * 600.0, ("media_seconds", "player 1 | Slow Air - Quartet"): 84 * 600.0,
                    ("productivity_score", None): 100.0}
    full = {(r.metric, r.key): r.value for r in daily.weekly_report(held, DAYS[0], rules).collect()}
    assert full[("day_seconds", "total")] == 7 * 24 * 600.0 == sum(v for (m, k), v in full.items() if m == "day_seconds" and k != "total")
    assert full[("productivity_score", None)] == pytest.approx(100 / 3)


def test_compaction_keeps_rows_and_order(spark, facts, store):
    for _ in range(3):  # the same rows again, as small files
        dated.write_days(facts["app_usage"].repartition(4), f"{store}/app_usage", "started_at")
    path, ddl = f"{store}/app_usage", dated.fact_ddl("app_usage")
    before = rows(dated.read_days(spark, path, ddl))
    files = dated.day_files(spark, path)
    assert set(files) == {*DAYS, None} and len(files[DAYS[0]]) >= 4
    assert dated.compact_days(spark, path, "started_at", ddl, most_files=2, before=DAYS[-1]) == DAYS[:-1]
    after = dated.day_files(spark, path)
    assert {d: len(f) for d, f in after.items() if d in DAYS[:-1]} == dict.fromkeys(DAYS[:-1], 1)
    assert after[DAYS[-1]] == files[DAYS[-1]] and after[None] == files[None]
    assert rows(dated.read_days(spark, path, ddl)) == before
    assert dated.row_groups_in_order(spark, [f for d in DAYS[:-1] for f in after[d]], "started_at")
    assert dated.compact_days(spark, path, "started_at", ddl, most_files=2, before=DAYS[-1]) == []


def test_missing_tables_have_no_rows(spark, tmp_path):
    held = dated.read_facts(spark, str(tmp_path / "none"))
    assert all(df.isEmpty() for df in held.values()) and dated.day_files(spark, str(tmp_path / "none")) == {}
    assert daily.productivity_score(held, DAYS[0], daily.default_rules(spark)).first().score == 0.0
    assert [r.metric for r in daily.weekly_report(held, DAYS[0], daily.default_rules(spark)).collect()] == ["productivity_score"]


# Users on the feed

def test_lines_of_two_users_are_two_rows(spark, tmp_path):
    line = '{"type":"app","app_name":"a","timestamp":"2026-05-01 10:00:00","id":%s,"user_id":%s}'
    text = [line % x for x in (("1", "7"), ("2", "8"), ('"3"', '"7"'), ("4", '"x"'), ("1.5", "7"), ("5", "null"))]
    path, rejects = str(tmp_path / "events"), str(tmp_path / "rejects")
    feed = lines.parse_event_lines(spark.createDataFrame([(t,) for t in text], "value STRING"))
    for _ in range(2):
        ingest_batch(feed, path, rejects, "2026-05-02 00:00:00")
    table = tables.read_usage_events(spark, path)
    assert sorted((r.user_id or 0, r.id) for r in table.collect()) == [(0, 5), (7, 1), (8, 2)]
    assert sorted(r.reasons[0] for r in spark.read.parquet(rejects).collect()) == ["id_invalid", "user_id_invalid"]
    assert table.where(F.col("created_at") == timestamp_lit("2026-05-02 00:00:00")).count() == 3


# Archive of a week

STEPS = ["_plan", "_copy", "_commit", "_delete", "_finish"]


def everything(spark, store, folder):
    """Rows by table, live and archived."""
    old = archive.read_archive(spark, folder, DAYS[0])
    return {t: rows(df.drop("event_date").unionByName(old[t].drop("event_date"))) for t, df in dated.read_facts(spark, store).items()}


def test_archive_moves_a_week_of_all_tables(spark, facts, store, tmp_path):
    folder, before = str(tmp_path / "archive"), everything(spark, store, str(tmp_path / "archive"))
    late = facts["media_track_change"].limit(3)
    dated.write_days(facts["app_usage"].limit(1).withColumn("started_at", F.col("started_at") + F.expr("INTERVAL '40' DAY")), f"{store}/app_usage", "started_at")
    assert archive.archive_facts(spark, store, folder, DAYS[0]) == 1
    live = {t: df.count() for t, df in dated.read_facts(spark, store).items()}
    assert live == {"app_usage": 2, "website_visits": 0, "website_usage": 0, "media_playback": 0, "media_track_change": 0}  # the timeless one and the later one
    dated.write_days(late, f"{store}/media_track_change", "changed_at")
    assert archive.archive_facts(spark, store, folder, DAYS[0]) == 2 and archive.archive_facts(spark, store, folder, DAYS[0]) == 2
    after = everything(spark, store, folder)
    assert after["media_track_change"] == sorted(before["media_track_change"] + rows(late))
    assert len(after["app_usage"]) == len(before["app_usage"]) + 1 and after["website_visits"] == before["website_visits"]
    assert archive.unfinished(spark, folder, DAYS[0]) == []


@pytest.mark.parametrize("when", ["before", "after"])
@pytest.mark.parametrize("step", STEPS)
def test_archive_recovers_from_any_step(spark, facts, tmp_path, monkeypatch, step, when):
    """A run is cut off just before or just after a step; the next run leaves each row in one place."""
    store, folder = str(tmp_path / "facts"), str(tmp_path / "archive")
    dated.write_facts({t: facts[t].limit(30) for t in ("app_usage", "media_playback")}, store)
    before = everything(spark, store, folder)
    real = getattr(archive, step)

    def cut(*args):
        if when == "after":
            real(*args)
        raise InterruptedError

    monkeypatch.setattr(archive, step, cut)
    with pytest.raises(InterruptedError):
        archive.archive_facts(spark, store, folder, DAYS[0])
    monkeypatch.setattr(archive, step, real)
    archive.archive_facts(spark, store, folder, DAYS[0])
    assert everything(spark, store, folder) == before and archive.unfinished(spark, folder, DAYS[0]) == []
    assert dated.read_facts(spark, store)["media_playback"].isEmpty()
