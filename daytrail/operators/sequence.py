"""Change detection, de-duplication, sessions and spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrail.functions.timeparts import epoch_us
from daytrail.functions.web import extract_domain
from daytrail.operators.joins import infer_session_url
from daytrail.operators.ordered import HOT_ROWS, hot_keys, islands, neighbour_row
from daytrail.operators.validation import MAX_DURATION_SECONDS

WINDOW = ("app_name", "window_title")
SIGNATURE = ("type", "app_name", "window_title")
BROWSERS = ("chrome", "msedge", "edge", "firefox", "brave", "opera")


def changed_only(df: DataFrame, same: Sequence[str] = WINDOW, keys: Sequence[str] = ("user_id",),
                 ts: str = "timestamp", order: Sequence[str] = ("timestamp", "id"),
                 max_gap_seconds: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows that differ from the row before them; a gap above the bound also counts as a change."""
    near = neighbour_row(df, hot_keys(df, keys, order, hot_rows), keys, order, [*same, ts])
    previous = F.col("_prev")
    repeats = previous.isNotNull()
    for c in same:
        repeats = repeats & F.col(c).eqNullSafe(previous[c])
    if max_gap_seconds is not None:
        repeats = repeats & (epoch_us(F.col(ts)) - epoch_us(previous[ts]) <= max_gap_seconds * 1_000_000)
    return near.where(~repeats).drop("_prev")


def event_signature(same: Sequence[str] = SIGNATURE) -> list[Column]:
    """Columns of a duplicate's signature; web rows are told apart by their URL too."""
    return [F.col(c) for c in same] + [F.when(F.col("type") == "web", F.col("url")).alias("_web_url")]


def dedupe_events(df: DataFrame, signature: Sequence[Column | str], order: Sequence[Column | str]
                  ) -> DataFrame:
    """First row of each signature, NULLs being equal.

    The rank bound is applied per task before the shuffle, so that a signature with many copies
    sends one row per task.
    """
    first = Window.partitionBy(*signature).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def sessionize(df: DataFrame, grace_seconds: int, keys: Sequence[str] = ("user_id",),
               same: Sequence[str] = WINDOW, ts: str = "timestamp",
               order: Sequence[str] = ("timestamp", "id"), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Sessions: runs of the same window with no break longer than the grace."""
    return islands(df, hot_keys(df, keys, order, hot_rows), keys, ts, order, same, grace_seconds * 1_000_000,
                   ["duration_seconds"])


def usage_spans(sessions: DataFrame, visits: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """App-usage rows of sessions; a browser's session also gets the page visited in it.

    `sessions`: user_id, app_name, window_title, started_at, ended_at. `visits`: user_id,
    browser, url, timestamp.
    """
    spans = sessions.withColumn(
        "duration_seconds",
        F.floor((epoch_us(F.col("ended_at")) - epoch_us(F.col("started_at"))) / 1_000_000).cast("long"))
    browser = F.lower(F.regexp_replace("app_name", r"(?i)\.exe$", ""))
    is_browser = browser.isin(*BROWSERS)
    app_rows = spans.select(
        F.lit("app_usage").alias("fact"), "user_id", "app_name", "window_title", "started_at",
        "ended_at", "duration_seconds", F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("domain"))
    web = infer_session_url(spans.where(is_browser).withColumn("browser", browser), visits, hot_rows)
    web_rows = web.where(F.col("url").isNotNull()).select(
        F.lit("website_usage").alias("fact"), "user_id", "app_name", "window_title", "started_at",
        "ended_at", "duration_seconds", "url", extract_domain(F.col("url")).alias("domain"))
    return app_rows.unionByName(web_rows)


def media_sessions(polls: DataFrame, keys: Sequence[str] = ("user_id", "source_app"),
                   ts: str = "polled_at", order: Sequence[str] = ("polled_at", "id"),
                   poll_interval_seconds: int = 5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Play spans of each player: a pause, another track or the last poll closes one.

    A poll adds the time to the next one: what the position moved, where both positions are
    known, belong to one track and moved by no more than the clock did and one poll interval;
    else the time on the clock.
    """
    hot = hot_keys(polls, keys, order, hot_rows)
    near = neighbour_row(polls, hot, keys, order, [ts, "title", "artist", "position_ticks"],
                         name="_next", following=True)
    following = F.col("_next")
    clock = epoch_us(following[ts]) - epoch_us(F.col(ts))
    moved = F.floor((following["position_ticks"] - F.col("position_ticks")) / 10).cast("long")
    same_track = (F.col("title").eqNullSafe(following["title"])
                  & F.col("artist").eqNullSafe(following["artist"]))
    sane = same_track & moved.between(F.lit(0), clock + poll_interval_seconds * 1_000_000)
    timed = near.withColumn("played_us", F.when(following.isNull(), F.lit(0).cast("long")).when(
        sane, moved).otherwise(clock)).drop("_next")
    spans = islands(timed, hot, keys, ts, order, ["playback_state", "title", "artist"], sums=["played_us"])
    return spans.where(F.col("playback_state") == "playing").select(
        *keys, "title", "artist", "started_at", F.col("ended_at").alias("last_seen"),
        "n_events", (F.col("played_us") / 1_000_000).alias("duration_seconds"))


def track_changes(polls: DataFrame, keys: Sequence[str] = ("user_id", "source_app"),
                  ts: str = "polled_at", order: Sequence[str] = ("polled_at", "id"),
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per new track of a player; a repeated poll adds none."""
    return changed_only(polls, ("title", "artist"), keys, ts, order, hot_rows=hot_rows)


def derive_durations(df: DataFrame, cap: int = MAX_DURATION_SECONDS, keys: Sequence[str] = ("user_id",),
                     ts: str = "timestamp", order: Sequence[str] = ("timestamp", "id"),
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """Fill a missing or zero duration with the time to the user's next event, up to a cap."""
    near = neighbour_row(df, hot_keys(df, keys, order, hot_rows), keys, order, [ts], name="_next",
                         following=True)
    until_next = F.floor((epoch_us(F.col("_next")[ts]) - epoch_us(F.col(ts))) / 1_000_000)
    derived = F.least(F.coalesce(until_next, F.lit(0)), F.lit(cap)).cast("int")
    recorded = F.nullif(F.col("duration_seconds"), F.lit(0))
    return near.withColumn("duration_seconds", F.coalesce(recorded, derived)).drop("_next")


def high_watermark(df: DataFrame, by: str = "source", ts: str = "timestamp") -> DataFrame:
    """Newest event time per source; a source without rows keeps its old mark elsewhere."""
    return df.groupBy(by).agg(F.max(ts).alias("watermark"))
