from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from daytrail.operators import lifecycle, unified
from daytrail.plans import daily
from daytrail.session import scratch_dir
from daytrail.sources import files, lines

DAY = "2026-03-18"


@pytest.fixture
def normal(spark):
    """Unified rows of (event_type, payload) pairs."""
    def run(*events):
        ddl = f"event_type STRING, {unified.PAYLOAD_DDL}"
        return unified.normalize_event(spark.createDataFrame(
            [(kind, *[p.get(f) for f in unified.PAYLOAD_FIELDS]) for kind, p in events], ddl))

    return run


CODE = ("APP_USAGE", {"ended_at": "2026-03-18T10:00:00Z", "duration_seconds": "60", "app_name": "Code", "window_title": "main.py - VS Code"})
THREE = [
    ("APP_USAGE", {"ended_at": "2026-03-18T06:00:00Z", "duration_seconds": "120", "app_name": "Code", "window_title": "repo"}),
    ("WEBSITE_USAGE", {"ended_at": "2026-03-18T10:00:00Z", "duration_seconds": "240", "domain": "github.com", "url": "https://github.com"}),
    ("MEDIA_PLAYBACK", {"ended_at": "2026-03-18T18:00:00Z", "duration_seconds": "300", "source_app": "Spotify", "title": "Song A", "artist": "Artist A"}),
]


def test_categories(one):
    got = one(unified.event_category(F.col("c")), "APP_USAGE", "WEBSITE_VISIT", "MEDIA_TRACK_CHANGE", "WEEKLY_RESET")
    assert got == ["APP", "WEB", "MEDIA", "OTHER"]


def test_normalize(normal):
    app, web, media = normal(*THREE).orderBy("timestamp").collect()
    assert (app.category, app.item, app.shift_id) == ("APP", "Code", 1)
    assert (web.category, web.item, web.url, web.shift_id) == ("WEB", "github.com", "https://github.com", 2)
    assert (media.category, media.source, media.item, media.shift_id) == ("MEDIA", "Spotify", "Song A - Artist A", 3)


def test_keys_are_deterministic_and_distinct(normal):
    same = normal(CODE, CODE).select("event_key").distinct().count()
    apps = normal(*[("APP_USAGE", dict(CODE[1], app_name=f"App{i}")) for i in range(10)])
    micro = normal(*[("APP_USAGE", dict(CODE[1], ended_at=f"2026-03-18T10:00:00.{i}34567Z")) for i in (1, 2)])
    shifted = normal(("APP_USAGE", dict(CODE[1], app_name="a", window_title="bc")), ("APP_USAGE", dict(CODE[1], app_name="ab", window_title="c")))
    counts = [df.select("event_key").distinct().count() for df in (apps, micro, shifted)]
    assert [same, *counts] == [1, 10, 2, 2]


def test_structured_and_legacy_lines(spark):
    text = ['[2026-03-18 10:00:00] | APP | Code | {"event_type":"APP_USAGE","duration_seconds":60,"window_title":"repo","app_name":"Code"}',
            '{"logged_at":"2026-03-18T10:00:00Z","event_type":"APP_USAGE","data":{"duration_seconds":60,"app_name":"Code","window_title":"repo"}}',
            "noise", '[2026-03-18 10:00:00] | APP | Code | {broken}']
    parsed = unified.parse_log_lines(spark.createDataFrame([(t,) for t in text], "value STRING"))
    got = unified.normalize_event(parsed.where("event_type IS NOT NULL")).collect()
    assert len(got) == 2
    assert {(str(r.timestamp), r.item, r.window, r.duration_seconds) for r in got} == {("2026-03-18 10:00:00", "Code", "repo", 60)}
    assert parsed.where("event_type IS NULL").count() == 2


def test_log_round_trip(spark, normal, tmp_path):
    rows = normal(CODE, *THREE, ("APP_USAGE", dict(CODE[1], app_name="a | b", window_title='q"\n|')))
    lines.write_structured_log(rows, str(tmp_path / "log"))
    back = lines.read_structured_log(spark, str(tmp_path / "log"))
    assert rows.drop("event_key").exceptAll(back.drop("event_key")).count() == 0 and back.count() == 5


def test_daily_sections_total(normal):
    sections = unified.daily_sections(normal(*THREE), DAY)
    total = {r.metric: r.duration_seconds for r in sections.where("section = 'Summary'").collect()}
    assert total["total_time_seconds"] == 660 and total["total_events"] == 3
    names = {r.section for r in sections.select("section").distinct().collect()}
    assert names == {"Usage_Log", "Browser_Log", "Media_Log", "Shift1", "Shift2", "Shift3", "Summary"}


def test_daily_csv(spark, normal, tmp_path):
    files.export_daily_csv(normal(*THREE), DAY, str(tmp_path))
    text = "".join(p.read_text() for p in (tmp_path / f"date={DAY}").glob("*.csv")).splitlines()
    header = "timestamp,category,item,duration_seconds,duration_readable,source,event_type,window,url"
    assert header in text and len([t for t in text if t != header]) == 3
    files.export_shift_csv(normal(*THREE), DAY, 2, str(tmp_path / "s"))
    [row] = files.read_daily_csv(spark, str(tmp_path / "s")).collect()
    assert (row.item, row.duration_readable) == ("github.com", "4m 0s")


def test_consolidation_merges_log_facts_and_daily_csv(spark, normal, tmp_path):
    payload = dict(CODE[1], window_title="repo")
    log = normal(("APP_USAGE", payload))
    facts = normal(("APP_USAGE", dict(payload, logged_at="2026-03-18T10:00:00Z", started_at="2026-03-18T09:59:00Z", process_name="Code.exe")))
    day = spark.createDataFrame([("2026-03-18 10:00:00.000000", "APP", "Code", "60", "1m 0s", "code.exe", "APP_USAGE", "repo", "")],
                                ", ".join(f"{c} STRING" for c in files.DAILY_CSV_COLUMNS))
    got = unified.consolidate_logs(log, facts, unified.read_daily_rows(day)).collect()
    assert len(got) == 1


def test_collect_since_and_rerun(normal):
    log = normal(CODE, CODE, ("WEBSITE_USAGE", {"ended_at": "2026-03-18T11:00:00Z", "duration_seconds": "120", "domain": "example.com"}))
    new = unified.collect_since(log, "2026-03-18 09:00:00")
    assert new.count() == 2
    assert unified.collect_since(log, "2026-03-18 10:30:00").count() == 1
    assert unified.collect_since(log, "2026-03-18 09:00:00", new).isEmpty()


def test_fan_out(spark):
    rows = [("APP_USAGE", "Code", None), ("WEBSITE_VISIT", None, "https://g"), ("WEBSITE_USAGE", None, "https://g"), ("MEDIA_PLAYBACK", None, None)]
    out = unified.fan_out_facts(spark.createDataFrame(rows, "event_type STRING, app_name STRING, url STRING"))
    assert {t: df.count() for t, df in out.items()} == {
        "app_usage": 1, "website_visits": 1, "website_usage": 1, "media_playback": 1, "media_track_change": 0}


def test_integrity(spark):
    df = spark.createDataFrame([("dup", "2026-03-17 06:00:00", 3, "APP_USAGE", "APP")] * 2 + [("visit", "2026-03-17 09:00:00", 1, "WEBSITE_VISIT", "WEB")],
                               "event_key STRING, timestamp STRING, shift_id INT, event_type STRING, category STRING").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    report, repaired = lifecycle.integrity_check(df)
    r = report.first()
    assert (r.status, r.duplicate_keys, r.repaired) == ("ISSUES", 1, 3)
    assert {(x.event_key, x.shift_id) for x in repaired.collect()} == {("dup", 1), ("visit", 2)}
    assert lifecycle.integrity_check(repaired)[0].first().status == "OK"


def test_prune_keeps_cutoff_day(normal):
    rows = normal(*[("APP_USAGE", dict(CODE[1], ended_at=t)) for t in ("2026-03-30T23:59:59Z", "2026-03-31T00:00:00Z", "2026-03-31T00:00:01Z")])
    kept, summary = lifecycle.prune_before(rows, "2026-03-31")
    s = summary.first()
    assert (s.removed_events, s.remaining_events, s.last_shift_export_key, kept.count()) == (1, 2, "", 2)


def due(df, *args):
    out = {"shift": [], "day": []}
    for r in lifecycle.scheduled_exports(df, *args).orderBy("export_key").collect():
        out[r.kind].append(r.export_key)
    return out


def test_scheduled_exports(normal):
    rows = normal(("APP_USAGE", dict(CODE[1], ended_at="2026-03-18T02:00:00Z")), ("APP_USAGE", dict(CODE[1], ended_at="2026-03-18T10:00:00Z")))
    assert due(rows, "2026-03-19 01:00:00") == {"shift": [f"2026-03-18-shift{n}" for n in (1, 2, 3)], "day": ["2026-03-18"]}
    assert due(rows, "2026-03-18 18:00:00") == {"shift": ["2026-03-18-shift1", "2026-03-18-shift2"], "day": []}
    assert due(rows, "2026-03-18 18:00:00", "2026-03-18-shift1", "2026-03-18") == {"shift": ["2026-03-18-shift2"], "day": []}
    assert due(rows, "2026-03-20 00:00:00", "2026-03-25-shift3", "2026-03-25") == {"shift": [], "day": []}
    assert due(rows, "2026-03-20 00:00:00", None, "2026-03-18")["day"] == ["2026-03-19"]


def facts(spark, apps=(), sites=(), visits=(), media=()):
    def table(rows, ddl):
        return files.typed_facts(spark.createDataFrame(rows, ", ".join(f"{c} STRING" for c in ddl)))

    return {"app_usage": table(list(apps), unified.FACT_COLUMNS["app_usage"]),
            "website_usage": table(list(sites), unified.FACT_COLUMNS["website_usage"]),
            "website_visits": table(list(visits), unified.FACT_COLUMNS["website_visits"]),
            "media_playback": table(list(media), unified.FACT_COLUMNS["media_playback"])}


def span(day, start, end, seconds):
    """Columns logged_at, started_at, ended_at, duration_seconds."""
    return (f"{day}T{end}:30Z", f"{day}T{start}:00Z", f"{day}T{end}:00Z", str(seconds))


# Our own rules, so that what a name is classed as is told here.
RULES = [("app", "ledger", "productive"), ("domain", "tides.example.org", "productive"), ("domain", "games.example.net", "unproductive")]


@pytest.fixture
def day_facts(spark):
    """A row that came twice, two visits to one page, and a player's track that no rule names."""
    ledger = (*span("2025-11-05", "06:20", "06:55", 2100), "ledger-bin", "Ledger", "accounts of October")
    return facts(
        spark,
        [ledger, ledger, (*span("2025-11-05", "07:00", "07:05", 300), "viewer", "Chart Viewer", "harbour")],
        [(*span("2025-11-05", "07:10", "07:14", 240), "netfox", "tides.example.org", "https://tides.example.org/today", "Tides", "window"),
         (*span("2025-11-05", "07:20", "07:40", 1200), "netfox", "games.example.net", "https://games.example.net/r", "Reversi", "window")],
        [("2025-11-05T07:11:00Z", "2025-11-05T07:11:00Z", "netfox", "duckduckgo.com", "https://duckduckgo.com/?q=tide+tables", "tide tables", "file"),
         ("2025-11-05T07:12:00Z", "2025-11-05T07:12:00Z", "netfox", "duckduckgo.com", "https://duckduckgo.com/?q=tide+tables", "tide tables", "file"),
         ("2025-11-05T07:13:00Z", "2025-11-05T07:13:00Z", "netfox", "tides.example.org", "https://tides.example.org/today", "Tides", "file")],
        [(*span("2025-11-05", "06:30", "06:50", 1200), "Jukebox", "Ambient Harbour", "Foghorns", "playing")])


def test_daily_reports(spark, day_facts):
    day, rules = dt.date(2025, 11, 5), spark.createDataFrame(RULES, "kind STRING, name STRING, activity STRING")
    assert {r.app_name: r.total_seconds for r in daily.app_time(day_facts["app_usage"], day).collect()} == {"Ledger": 2100, "Chart Viewer": 300}
    assert daily.count_app_sessions(day_facts["app_usage"], day).first().sessions == 2
    assert {r.domain: r.total_seconds for r in daily.website_time(day_facts["website_usage"], day).collect()} == {
        "tides.example.org": 240, "games.example.net": 1200}
    assert {(r.domain, r.url): r.visits for r in daily.website_details(day_facts["website_visits"], day).collect()} == {
        ("duckduckgo.com", "https://duckduckgo.com/?q=tide+tables"): 2, ("tides.example.org", "https://tides.example.org/today"): 1}
    assert [(r.title, r.artist, r.total_seconds) for r in daily.media_time(day_facts["media_playback"], day).collect()] == [("Ambient Harbour", "Foghorns", 1200)]
    assert [(r.search_query, r.visits) for r in daily.daily_searches(day_facts["website_visits"], day).collect()] == [("tide tables", 2)]
    named = spark.createDataFrame([("app", "LEDGER"), ("domain", "games.example.net"), ("media", "Ambient Harbour - Foghorns"), ("media", "Reversi"), ("app", "other")],
                                  "kind STRING, name STRING")
    assert {r.name: r.activity for r in daily.classify_activity(named, rules).collect()} == {
        "LEDGER": "productive", "games.example.net": "unproductive", "Ambient Harbour - Foghorns": "productive", "Reversi": "neutral", "other": "neutral"}
    score = daily.productivity_score(day_facts, day, rules).first()
    assert (score.productive_seconds, score.neutral_seconds, score.unproductive_seconds, score.searches) == (3540, 300, 1200, 1)
    assert score.score == pytest.approx(100 * 3540 / 5040)
    insights = {r.insight: (r.subject, r.value) for r in daily.productivity_insights(day_facts, day, rules).collect()}
    assert insights["top_app"] == ("Ledger", 2100.0) and insights["top_site"] == ("games.example.net", 1200.0)
    assert insights["mean_session_seconds"][1] == 1200.0 and insights["distraction_share"][1] == pytest.approx(100 * 1200 / 5040)
    assert daily.productivity_score(day_facts, "2025-11-06", rules).first().score == 0


def test_weekly_reports(spark):
    """Monday to Sunday; a row before the week and one after it stay out."""
    outside = [(*span(day, "12:00", "12:01", 60), "clock", "Clock", "") for day in ("2025-11-02", "2025-11-10")]
    week = facts(
        spark,
        [(*span("2025-11-03", "00:00", "01:30", 5400), "ledger-bin", "Ledger", "a"), (*span("2025-11-09", "23:10", "23:50", 2400), "viewer", "Chart Viewer", "b"), *outside],
        [(*span("2025-11-05", "07:10", "07:25", 900), "netfox", "tides.example.org", "https://tides.example.org/", "Tides", "window")],
        media=[(*span("2025-11-04", "20:00", "20:03", 180), "Jukebox", "Slow Swell", "Foghorns", "playing")])
    start, rules = "2025-11-03", spark.createDataFrame(RULES, "kind STRING, name STRING, activity STRING")
    assert {r.app_name: r.total_seconds for r in daily.weekly_apps(week["app_usage"], start).collect()} == {"Ledger": 5400, "Chart Viewer": 2400}
    assert [(r.domain, r.total_seconds) for r in daily.weekly_websites(week["website_usage"], start).collect()] == [("tides.example.org", 900)]
    assert daily.weekly_media(week["media_playback"], start).first().track == "Jukebox | Slow Swell - Foghorns"
    assert daily.weekly_total(week["app_usage"], start, "2025-11-09").first().total_seconds == 7800
    report = {(r.metric, r.key): r.value for r in daily.weekly_report(week, start, rules).collect()}
    assert report["day_seconds", "2025-11-03"] == 5400 and report["day_seconds", "total"] == 7800
    assert report["productivity_score", None] == pytest.approx(100 * 6300 / 8880)


def test_weekly_update_day(normal):
    friday = normal(("APP_USAGE", dict(CODE[1], ended_at="2026-03-20T10:00:00+00:00", duration_seconds=str(5 * 3600))))
    assert daily.weekly_update_day(friday, "2026-03-16").first().update_day == 5
    assert daily.weekly_update_day(friday, "2026-03-16", 5).first().update_day == 4


def test_shift_summary_total(normal):
    got = daily.shift_summary(normal(*THREE), DAY).where("level = 3").first()
    assert (got.total_seconds, got.events) == (660, 3)
    assert daily.first_event_date(normal(*THREE)).first().first_date == dt.date(2026, 3, 18)


def test_volume_and_inventory(spark, tmp_path):
    (tmp_path / "daily").mkdir()
    (tmp_path / "daily" / "small.csv").write_bytes(b"0" * 1024)
    assert not daily.volume_check(lines.list_files(spark, str(tmp_path))).first().enough
    (tmp_path / "daily" / "large.csv").write_bytes(b"1\n" * 5_000_000)
    assert daily.volume_check(lines.list_files(spark, str(tmp_path))).first().enough
    r = lines.source_inventory(spark, str(tmp_path)).first()
    assert (r.source, r.files, r.lines) == ("daily", 2, 5_000_001)


def test_fact_files(spark, day_facts, tmp_path):
    two_lines = day_facts["app_usage"].withColumn("window_title", F.lit('a "b"\r\nc'))
    files.write_fact_logs({"app_usage": two_lines}, str(tmp_path))
    back = files.read_fact_logs(spark, str(tmp_path))
    assert back["app_usage"].columns == unified.FACT_COLUMNS["app_usage"] and back["app_usage"].count() == 3
    assert {r.window_title for r in back["app_usage"].collect()} == {'a "b"\r\nc'}
    assert all(back[t].isEmpty() and back[t].columns == c for t, c in unified.FACT_COLUMNS.items() if t != "app_usage")


def test_other_events_keep_their_fields(spark):
    rows = unified.normalize_event(spark.createDataFrame(
        [("WEEKLY_RESET", "job", "host.example", "done", "2026-03-18T10:00:00", "5")],
        "event_type STRING, source STRING, domain STRING, title STRING, ended_at STRING, duration_seconds STRING"))
    back = unified.normalize_event(unified.parse_log_lines(rows.select(unified.structured_line(rows).alias("value"))))
    assert back.select(*rows.columns).collect() == rows.collect()


class FakeSession:
    """A cluster's session, as far as the scratch folder asks."""

    def __init__(self, master, folder):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: folder or default)})


def test_scratch_folder_follows_the_session(spark):
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")
    assert scratch_dir(FakeSession("yarn", "hdfs://shared/c/"), "x").startswith("hdfs://shared/c/x-")
    with pytest.raises(ValueError):
        scratch_dir(FakeSession("yarn", None), "x")
