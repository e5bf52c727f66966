"""Hot keys: cut into chunks, the results must be those of a plain window."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.bindings import bind
from daytrail.operators import joins, ordered, sequence

HOT = 20  # rows that make a key hot here
ORDER = ["timestamp", "id"]


@pytest.fixture(scope="module")
def events(spark, small):
    """One user holds a third of all rows; gaps and equal windows span chunk borders."""
    df = bind(spark, small, "usage_events")
    hot = F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("user_id")).cast("long")
    return df.withColumns({
        "user_id": hot, "app_name": F.when(F.col("id") % 11 < 7, "same").otherwise(F.col("app_name"))}).cache()


def rows(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def test_hot_keys_are_found_and_bounded(events):
    hot = ordered.hot_keys(events, ["user_id"], ORDER, HOT).collect()
    assert 1 in [r.user_id for r in hot]
    assert ordered.hot_keys(events, ["user_id"], ORDER).isEmpty()
    chunks = ordered.with_chunk(events, ordered.hot_keys(events, ["user_id"], ORDER, HOT), ORDER)
    sizes = chunks.where("user_id = 1").groupBy("_chunk").count()
    assert sizes.count() > 10
    assert sizes.agg(F.max("count")).first()[0] < 4 * HOT


@pytest.mark.parametrize("following", [False, True])
def test_neighbour_row(events, following):
    hot = ordered.hot_keys(events, ["user_id"], ORDER, HOT)
    got = ordered.neighbour_row(events, hot, ["user_id"], ["timestamp", "id"], ["id"], "near", following)
    w = Window.partitionBy("user_id").orderBy("timestamp", "id")
    want = events.withColumn("near", (F.lead if following else F.lag)(F.struct("id")).over(w))
    assert rows(got.select("id", "near")) == rows(want.select("id", "near"))


def test_carry_last(events):
    marked = events.withColumn("mark", F.when(F.col("id") % 97 == 0, F.col("id")))
    hot = ordered.hot_keys(marked, ["user_id"], ORDER, HOT)
    got = ordered.carry_last(marked, hot, ["user_id"], ["timestamp", "id"], "mark", "last")
    w = Window.partitionBy("user_id").orderBy("timestamp", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = marked.withColumn("last", F.last("mark", True).over(w))
    assert rows(got.select("id", "last")) == rows(want.select("id", "last"))


@pytest.mark.parametrize("grace", [600, 7200, 864000])
def test_sessionize(events, grace):
    split = sequence.sessionize(events, grace, same=("app_name",), hot_rows=HOT)
    plain = sequence.sessionize(events, grace, same=("app_name",))
    assert rows(split) == rows(plain)
    assert split.agg(F.sum("n_events")).first()[0] == events.count()


def test_one_session_over_many_chunks(spark):
    df = spark.range(1000).select(
        "id", F.lit(1).alias("user_id"), F.lit("a").alias("app_name"), F.lit(None).cast("string").alias("window_title"),
        F.timestamp_add("SECOND", F.col("id"), F.lit("2026-01-01").cast("timestamp_ntz")).alias("timestamp"),
        F.lit(1).alias("duration_seconds"))
    [r] = sequence.sessionize(df, 5, hot_rows=10).collect()
    assert (r.n_events, r.duration_seconds) == (1000, 1000)


def test_other_sequence_operators(events, spark, small):
    for run in (lambda n: sequence.changed_only(events, ("app_name",), max_gap_seconds=3600, hot_rows=n),
                lambda n: sequence.derive_durations(events.withColumn("duration_seconds", F.lit(0)), hot_rows=n),
                lambda n: sequence.media_sessions(polls, hot_rows=n),
                lambda n: sequence.track_changes(polls, hot_rows=n)):
        polls = bind(spark, small, "media_polls").withColumns({
            "user_id": F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("user_id")), "source_app": F.lit("p")})
        assert rows(run(HOT)) == rows(run(ordered.HOT_ROWS))


def test_as_of_with_hot_key(spark, small):
    windows, visits = bind(spark, small, "browser_windows"), bind(spark, small, "page_visits")
    hot_user = F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("user_id"))
    windows, visits = windows.withColumn("user_id", hot_user), visits.withColumn("user_id", hot_user)
    sessions = bind(spark, small, "browser_sessions").withColumn("user_id", hot_user)
    for run in (lambda n: joins.infer_active_url(windows, visits, 864000, n),
                lambda n: joins.infer_session_url(sessions, visits, n)):
        assert rows(run(HOT)) == rows(run(ordered.HOT_ROWS))


def test_plan_has_no_nested_loop(events, spark, small):
    plans = [sequence.sessionize(events, 60), sequence.changed_only(events),
             joins.infer_session_url(bind(spark, small, "browser_sessions"), bind(spark, small, "page_visits"))]
    for df in plans:
        text = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        assert "NestedLoop" not in text and "CartesianProduct" not in text and "Python" not in text


def test_dedupe_ranks_before_the_shuffle(events):
    df = sequence.dedupe_events(events, sequence.event_signature(), ["timestamp", "id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    final, partial = plan.index("Final"), plan.index("Partial")
    assert "WindowGroupLimit" in plan and "Exchange hashpartitioning" in plan[final:partial]


def test_random_chunks_against_brute_force(spark):
    rng = random.Random(7)
    data = sorted((rng.randrange(3000), i, rng.choice("ab"), rng.randrange(1, 9)) for i in range(400))
    df = spark.createDataFrame([(1, t, i, a, d) for t, i, a, d in data],
                               "user_id INT, t INT, id INT, app_name STRING, duration_seconds INT").withColumns({
        "timestamp": F.timestamp_add("SECOND", F.col("t"), F.lit("2026-01-01").cast("timestamp_ntz")),
        "window_title": F.lit(None).cast("string")})
    sessions, last = [], None
    for t, _, a, d in data:
        if last and last[0] == a and t - last[1] <= 12:
            sessions[-1][1:] = [t, sessions[-1][2] + 1, sessions[-1][3] + d]
        else:
            sessions.append([t, t, 1, d])
        last = (a, t)
    got = sequence.sessionize(df, 12, hot_rows=15).select(
        F.timestamp_diff("SECOND", F.lit("2026-01-01").cast("timestamp_ntz"), "started_at").alias("s"),
        F.timestamp_diff("SECOND", F.lit("2026-01-01").cast("timestamp_ntz"), "ended_at").alias("e"), "n_events", "duration_seconds")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sessions))


@pytest.fixture(scope="module")
def burst(spark):
    """One user's rows: most of them at one time, many without a time, few elsewhere; some without an id as well."""
    df = spark.range(6000).select(
        F.when(F.col("id") % 50 > 0, F.col("id")).alias("id"), F.lit(1).alias("user_id"),
        F.when(F.col("id") % 10 < 6, F.lit("2026-01-01 10:00:00").cast("timestamp_ntz")).when(
            F.col("id") % 10 == 9, F.timestamp_add("SECOND", F.col("id"), F.lit("2026-01-01").cast("timestamp_ntz"))).alias("timestamp"),
        F.when(F.col("id") % 7 < 3, "a").otherwise("b").alias("app_name"), F.col("id").cast("string").alias("window_title"),
        F.lit(1).alias("duration_seconds"))
    return df.where("id IS NOT NULL OR timestamp IS NULL").cache()


def test_a_burst_is_cut(burst):
    hot = ordered.hot_keys(burst, ["user_id"], ORDER, 100)
    chunks = ordered.with_chunk(burst, hot, ORDER)
    sizes = sorted(r["count"] for r in chunks.groupBy("_chunk").count().collect())
    assert len(sizes) > 30 and sizes[-1] < 4 * sizes[len(sizes) // 2]
    at_once = chunks.where("timestamp = TIMESTAMP_NTZ'2026-01-01 10:00:00'").select("_chunk").distinct().count()
    timeless = chunks.where("timestamp IS NULL").select("_chunk").distinct().count()
    assert at_once > 15 and timeless > 8


def test_rows_of_a_burst_keep_their_results(burst):
    known = burst.where("id IS NOT NULL")
    for run in (lambda n: sequence.changed_only(known, ("app_name",), hot_rows=n), lambda n: sequence.sessionize(known, 60, same=("app_name",), hot_rows=n),
                lambda n: sequence.derive_durations(known.withColumn("duration_seconds", F.lit(0)), hot_rows=n)):
        assert rows(run(100)) == rows(run(ordered.HOT_ROWS))
    visits = known.select("user_id", F.lit("firefox").alias("browser"), "timestamp", "id", F.col("window_title").alias("url")).where("id % 3 = 0")
    sessions = known.select("user_id", F.lit("firefox").alias("browser"), "app_name", "window_title", F.col("timestamp").alias("started_at"),
                            F.col("timestamp").alias("ended_at"))
    assert rows(joins.infer_session_url(sessions, visits, 100)) == rows(joins.infer_session_url(sessions, visits))


def test_summaries_of_chunks_meet_in_one_place_only(burst):
    """A key without hot rows has no chunk, and one more shuffle is all that hot keys cost."""
    hot = ordered.hot_keys(burst, ["user_id"], ORDER)
    assert ordered.with_chunk(burst, hot, ORDER).where("_chunk IS NOT NULL OR _tie_hash IS NOT NULL").isEmpty()
