from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from daytrail.operators import joins, sequence
from daytrail.streaming import windows

T0 = datetime(2026, 3, 17, 10, 0)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def windows_of(spark, *rows):
    return spark.createDataFrame([(1, i, a, w, at(s), 0) for i, (a, w, s) in enumerate(rows)],
                                 "user_id INT, id INT, app_name STRING, window_title STRING, timestamp TIMESTAMP_NTZ, duration_seconds INT")


def test_changed_only(spark):
    df = windows_of(spark, ("a", "x", 0), ("a", "x", 5), ("a", "y", 10), ("a", "y", 300), ("b", "y", 305), ("b", None, 310), ("b", None, 315))
    assert [r.id for r in sequence.changed_only(df).orderBy("id").collect()] == [0, 2, 4, 5]
    assert [r.id for r in sequence.changed_only(df, max_gap_seconds=60).orderBy("id").collect()] == [0, 2, 3, 4, 5]


def test_grace_keeps_one_session(spark):
    df = windows_of(spark, ("notepad", "u", 0), ("notepad", "u", 1), ("notepad", "u", 6))
    got = sequence.sessionize(df, 3).orderBy("started_at").collect()
    assert [(r.started_at, r.ended_at, r.n_events) for r in got] == [(at(0), at(1), 2), (at(6), at(6), 1)]


def test_dedupe_keeps_first_and_treats_nulls_as_equal(spark):
    df = spark.createDataFrame(
        [(1, "app", "a", None, None), (2, "app", "a", None, None), (3, "web", "c", None, "u1"), (4, "web", "c", None, "u2"), (5, "app", "b", None, None)],
        "id INT, type STRING, app_name STRING, window_title STRING, url STRING")
    got = sequence.dedupe_events(df, sequence.event_signature(), ["id"])
    assert sorted(r.id for r in got.collect()) == [1, 3, 4, 5]
    assert sequence.dedupe_events(df.select(F.lit(1).alias("k"), "id"), ["k"], ["id"]).count() == 1


def polls(spark, *rows):
    return spark.createDataFrame([(1, i, app, t, "A", s, p * 10_000_000, at(x)) for i, (app, t, s, p, x) in enumerate(rows)],
                                 "user_id INT, id INT, source_app STRING, title STRING, artist STRING, playback_state STRING, position_ticks LONG, polled_at TIMESTAMP_NTZ")


def test_media_span_closes_on_pause(spark):
    df = polls(spark, ("Edge", "Song A", "playing", 0, 0), ("Edge", "Song A", "playing", 30, 30), ("Edge", "Song A", "paused", 30, 40))
    [r] = sequence.media_sessions(df).collect()
    assert r.duration_seconds >= 30 and r.title == "Song A"


def test_media_position_delta_is_used(spark):
    [r] = sequence.media_sessions(polls(spark, ("spotify", "S", "playing", 1, 0), ("spotify", "S", "playing", 6, 5))).collect()
    assert r.duration_seconds == 5.0


def test_media_two_players_and_track_change(spark):
    df = polls(spark, ("Edge", "A", "playing", 5, 0), ("Spotify", "B", "playing", 5, 0), ("Edge", "A", "playing", 40, 35),
               ("Spotify", "B", "playing", 50, 35), ("Edge", "A", "paused", 40, 40), ("Spotify", "B", "paused", 50, 40))
    assert {r.source_app for r in sequence.media_sessions(df).collect()} == {"Edge", "Spotify"}
    changes = sequence.track_changes(polls(spark, ("Edge", "A", "playing", 0, 0), ("Spotify", "B", "playing", 0, 0), ("Edge", "A", "playing", 1, 1), ("Spotify", "B", "playing", 1, 1)))
    assert changes.count() == 2
    spans = sequence.media_sessions(polls(spark, ("Edge", "Song A", "playing", 5, 0), ("Edge", "Song B", "playing", 40, 30)))
    assert {(r.title, r.duration_seconds) for r in spans.collect()} == {("Song A", 30.0), ("Song B", 0.0)}


def test_derived_durations(spark):
    df = windows_of(spark, ("a", "x", 0), ("b", "x", 90), ("c", "x", 200_000))
    assert [r.duration_seconds for r in sequence.derive_durations(df).orderBy("id").collect()] == [90, 86400, 0]


def test_history_join_and_watermark(spark):
    urls = spark.createDataFrame([(1, "https://a", "A"), (2, "https://b", "  "), (3, "https://c", None)], "id LONG, url STRING, title STRING")
    base = 13_349_318_400_000_000
    visits = spark.createDataFrame([(1, base, 1), (1, base + 1, 2_500_000), (2, base + 2, 0), (3, base + 2, 0)], "url LONG, visit_time LONG, visit_duration LONG")
    got = joins.browser_history(visits, urls, base).collect()
    assert [(r.url, r.duration_seconds) for r in got] == [("https://a", 2)]
    raw = joins.browser_history(visits, urls, base, duration_unit="raw").collect()
    assert raw[0].duration_seconds == 2_500_000


def test_poll_browsers(spark):
    ddl = "source STRING, browser STRING, url STRING, title STRING, visit_time LONG"
    chromium = spark.createDataFrame([("chrome:test", "chrome", "https://example.com/one", "Example One", 11_644_473_600_000_001), ("chrome:test", "chrome", "not-a-web-url", "Ignored", 99)], ddl)
    firefox = spark.createDataFrame([("firefox:test", "firefox", "https://firefox.example", "F", 1_773_741_720_000_000)], ddl)
    marks = spark.createDataFrame([("chrome:test", 5)], "source STRING, marker LONG")
    got = joins.poll_browsers(chromium, firefox, marks).orderBy("visited_at").collect()
    assert [(r.browser, r.domain) for r in got] == [("chrome", "example.com"), ("firefox", "firefox.example")]


def test_active_and_session_url(spark):
    visits = spark.createDataFrame([(1, 1, "chrome", "Search Results", "https://example.com/search", at(290)), (2, 1, "chrome", "Other", "https://o", at(295))],
                                   "id INT, user_id INT, browser STRING, title STRING, url STRING, timestamp TIMESTAMP_NTZ")
    window = spark.createDataFrame([(1, "chrome", "Search Results - Google Chrome", at(300))], "user_id INT, browser STRING, window_title STRING, timestamp TIMESTAMP_NTZ")
    assert joins.infer_active_url(window, visits, 60).first().url == "https://example.com/search"
    assert joins.infer_active_url(window, visits, 9).first().url is None
    session = spark.createDataFrame([(1, "chrome", at(270), at(292)), (1, "chrome", at(296), at(300))], "user_id INT, browser STRING, started_at TIMESTAMP_NTZ, ended_at TIMESTAMP_NTZ")
    got = joins.infer_session_url(session, visits).orderBy("started_at").collect()
    assert [r.url for r in got] == ["https://example.com/search", None]


def test_reconcile_is_empty_after_healing(spark):
    a = spark.createDataFrame([("k1",), ("k2",), ("k2",)], "event_key STRING")
    b = spark.createDataFrame([("k2",), ("k3",), ("k3",)], "event_key STRING")
    assert {tuple(r) for r in joins.reconcile(a, b).collect()} == {("k1", "b"), ("k3", "a")}
    healed_a, healed_b = a.union(joins.missing_rows(a, b)), b.union(joins.missing_rows(b, a))
    assert joins.reconcile(healed_a, healed_b).isEmpty() and healed_a.count() == 4


def test_session_stream_emits_the_closed_batch_sessions(spark, small, tmp_path):
    from checks.bindings import bind

    events = bind(spark, small, "usage_events")
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.session_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "30 minutes", "1 hour")
    windows.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = events.groupBy(F.session_window(F.col("timestamp").cast("timestamp"), "30 minutes"), "user_id", "app_name", "window_title").agg(
        F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"), F.count("*").alias("n_events"), F.sum("duration_seconds").alias("duration_seconds"))
    newest = events.agg(F.max("timestamp")).first()[0]
    closed = want.where(F.col("session_window.end").cast("timestamp_ntz") <= newest - timedelta(hours=1)).drop("session_window")
    assert got.exceptAll(closed.select(got.columns)).isEmpty() and got.count() == closed.count()


def test_daily_summary_stream_counts(spark, small, tmp_path):
    from checks.bindings import bind

    events = bind(spark, small, "usage_events")
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.daily_summary_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "1 hour")
    windows.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("date", "type", "event_count")
    want = events.groupBy(F.col("timestamp").cast("date").alias("date"), "type").agg(F.count("*").alias("event_count"))
    assert got.exceptAll(want).isEmpty() and got.count() >= want.count() - 2


def test_dedupe_stream_over_several_batches(spark, tmp_path):
    rows = [(i, "app", "a" if i % 3 else "b", None, None, at(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "id INT, type STRING, app_name STRING, window_title STRING, url STRING, timestamp TIMESTAMP_NTZ")
    out = str(tmp_path / "out")
    for part in (df.where("id < 10"), df.where("id >= 10")):
        part.repartition(4).write.mode("append").parquet(str(tmp_path / "in"))
        stream = windows.dedupe_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")), "1 day")
        windows.run_to_table(stream, out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.app_name for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_hot_url_is_split_by_the_adaptive_join(spark):
    urls = spark.range(200).select("id", F.concat(F.lit("https://u"), "id").alias("url"), F.lit("t").alias("title"))
    visits = spark.range(400_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 200).alias("url"), (F.col("id") + 13_349_318_400_000_000).alias("visit_time"),
        F.lit(0).alias("visit_duration"), F.sha2(F.col("id").cast("string"), 256).alias("session")).repartition(16)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "500KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "500KB"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        df = joins.browser_history(visits, urls, 0)
        assert len(df.collect()) == 400_000
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
