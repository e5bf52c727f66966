"""Daily reports over the fact tables, and their weekly totals."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrail.functions.timeparts import shift_id
from daytrail.functions.web import extract_search_query
from daytrail.operators.filters import in_week, on_date

# Our own starting rules; pass a frame (kind, name, activity) to use others.
DEFAULT_RULES = [
    ("app", "visual studio code", "productive"), ("app", "vs code", "productive"),
    ("app", "code", "productive"), ("app", "pycharm", "productive"), ("app", "terminal", "productive"),
    ("app", "excel", "productive"), ("app", "word", "productive"), ("app", "steam", "unproductive"),
    ("app", "spotify", "neutral"), ("app", "discord", "unproductive"),
    ("domain", "github.com", "productive"), ("domain", "stackoverflow.com", "productive"),
    ("domain", "docs.python.org", "productive"), ("domain", "google.com", "neutral"),
    ("domain", "youtube.com", "unproductive"), ("domain", "facebook.com", "unproductive"),
    ("domain", "reddit.com", "unproductive"), ("domain", "netflix.com", "unproductive"),
]
FOCUS_WORDS = r"\b(lofi|lo-fi|focus|study|concentration|ambient|tutorial|lecture|course)\b"


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_RULES, "kind STRING, name STRING, activity STRING")


def classify_activity(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Add `activity` to rows with `kind` (app, domain, media) and `name`.

    A rule for the name decides; media without one are productive by their focus words; all else
    is neutral. Catalyst broadcasts the rules while they are small.
    """
    unique = rules.groupBy("kind", F.lower("name").alias("_name")).agg(F.min("activity").alias("_rule"))
    focus = (F.col("kind") == "media") & F.lower("name").rlike(FOCUS_WORDS)
    return df.withColumn("_name", F.lower("name")).join(unique, ["kind", "_name"], "left").withColumn(
        "activity", F.coalesce("_rule", F.when(focus, "productive"), F.lit("neutral"))
    ).drop("_name", "_rule")


def distinct_rows(df: DataFrame) -> DataFrame:
    """Exact duplicates once; copies are dropped per task before the shuffle."""
    return df.dropDuplicates(df.columns)


def _time_by(df: DataFrame, *by: Column | str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum("duration_seconds").alias("total_seconds"))


def app_time(app_usage: DataFrame, day: dt.date | str) -> DataFrame:
    """Seconds per application of a day, exact duplicates counted once."""
    return _time_by(distinct_rows(on_date(app_usage, day, "started_at")), "app_name")


def count_app_sessions(app_usage: DataFrame, day: dt.date | str) -> DataFrame:
    """One row: distinct sessions of a day."""
    sessions = on_date(app_usage, day, "started_at").select(
        *[c for c in app_usage.columns if c != "logged_at"])
    return distinct_rows(sessions).agg(F.count("*").alias("sessions"))


def website_time(website_usage: DataFrame, day: dt.date | str) -> DataFrame:
    return _time_by(distinct_rows(on_date(website_usage, day, "started_at")), "domain")


def website_details(visits: DataFrame, day: dt.date | str) -> DataFrame:
    """Distinct URLs of each domain of a day, one per row: a domain may have any number."""
    return on_date(visits, day, "visited_at").groupBy("domain", "url").agg(F.count("*").alias("visits"))


def media_time(media: DataFrame, day: dt.date | str) -> DataFrame:
    """Seconds per track and player, longest first."""
    return _time_by(distinct_rows(on_date(media, day, "started_at")), "title", "artist", "source_app").orderBy(
        F.col("total_seconds").desc(), "title", "artist", "source_app")


def daily_searches(visits: DataFrame, day: dt.date | str) -> DataFrame:
    """Search words of a day and how often they were visited."""
    found = on_date(visits, day, "visited_at").groupBy("url").agg(F.count("*").alias("_n"))
    return found.select(extract_search_query(F.col("url")).alias("search_query"), "_n").where(
        F.col("search_query").isNotNull()).groupBy("search_query").agg(F.sum("_n").alias("visits"))


def spent(facts: dict[str, DataFrame], pick) -> DataFrame:
    """Seconds by kind (app, domain, media), name, track and day of the rows that `pick` takes of each table.

    Exact duplicates count once. The tables meet before they are told apart, so that one shuffle serves all three.
    """
    names = {"app_usage": ("app", F.col("app_name")), "website_usage": ("domain", F.col("domain")),
             "media_playback": ("media", F.concat_ws(" - ", "title", "artist"))}
    track = F.concat_ws(" | ", "source_app", F.concat_ws(" - ", "title", "artist"))

    def rows(table: str) -> DataFrame:
        kind, name = names[table]
        df = pick(facts[table])
        return df.select(F.lit(kind).alias("kind"), name.alias("name"), (track if kind == "media" else F.lit(None).cast("string")).alias("track"),
                         F.col("started_at").cast("date").alias("day"), "duration_seconds", F.array(*[F.col(c).cast("string") for c in df.columns]).alias("_row"))

    once = distinct_rows(reduce(lambda a, b: a.unionByName(b), map(rows, names)))
    return once.groupBy("kind", "name", "track", "day").agg(F.sum("duration_seconds").alias("total_seconds"))


def activity_time(facts: dict[str, DataFrame], day: dt.date | str) -> DataFrame:
    """Seconds of a day by kind (app, domain, media) and name."""
    cells = spent(facts, lambda df: on_date(df, day, "started_at"))
    return cells.groupBy("kind", "name").agg(F.sum("total_seconds").alias("total_seconds"))


def _score(totals: DataFrame) -> DataFrame:
    def seconds(activity: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("activity") == activity, F.col("total_seconds"))), F.lit(0))

    summed = totals.agg(*[seconds(a).alias(f"{a}_seconds") for a in ("productive", "neutral", "unproductive")],
                        F.coalesce(F.sum("total_seconds"), F.lit(0)).alias("total_seconds"))
    return summed.withColumn("score", F.coalesce(
        F.lit(100.0) * F.col("productive_seconds") / F.nullif(F.col("total_seconds"), F.lit(0)), F.lit(0.0)))


def productivity_score(facts: dict[str, DataFrame], day: dt.date | str, rules: DataFrame) -> DataFrame:
    """One row: the score (share of productive time, in percent), class totals and searches."""
    searches = daily_searches(facts["website_visits"], day).agg(F.count("*").alias("searches"))
    score = _score(classify_activity(activity_time(facts, day), rules))
    return score.unionByName(searches, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in (*score.columns, "searches")])


def productivity_insights(facts: dict[str, DataFrame], day: dt.date | str, rules: DataFrame) -> DataFrame:
    """Findings of a day as rows `insight, subject, value`."""
    def top(df: DataFrame, name: str, insight: str) -> DataFrame:
        first = df.orderBy(F.col("total_seconds").desc(), name).limit(1)
        return first.select(F.lit(insight).alias("insight"), F.col(name).alias("subject"),
                            F.col("total_seconds").cast("double").alias("value"))

    score = _score(classify_activity(activity_time(facts, day), rules))
    total = F.nullif(F.col("total_seconds"), F.lit(0))
    distraction = score.select(
        F.lit("distraction_share").alias("insight"), F.lit(None).cast("string").alias("subject"),
        F.coalesce(F.lit(100.0) * F.col("unproductive_seconds") / total, F.lit(0.0)).alias("value"))
    day_apps = distinct_rows(on_date(facts["app_usage"], day, "started_at"))
    session = day_apps.agg(F.sum("duration_seconds").alias("_s"), F.count("*").alias("_n")).select(
        F.lit("mean_session_seconds").alias("insight"), F.lit(None).cast("string").alias("subject"),
        F.coalesce(F.col("_s") / F.nullif(F.col("_n"), F.lit(0)), F.lit(0.0)).alias("value"))
    return reduce(lambda a, b: a.unionByName(b), [
        top(app_time(facts["app_usage"], day), "app_name", "top_app"),
        top(website_time(facts["website_usage"], day), "domain", "top_site"), distraction, session])


def weekly_apps(app_usage: DataFrame, start: dt.date | str, end: dt.date | str | None = None) -> DataFrame:
    return _time_by(distinct_rows(in_week(app_usage, start, end, "started_at")), "app_name")


def weekly_websites(website_usage: DataFrame, start: dt.date | str, end: dt.date | str | None = None) -> DataFrame:
    return _time_by(distinct_rows(in_week(website_usage, start, end, "started_at")), "domain")


def weekly_media(media: DataFrame, start: dt.date | str, end: dt.date | str | None = None) -> DataFrame:
    track = F.concat_ws(" | ", "source_app", F.concat_ws(" - ", "title", "artist")).alias("track")
    return _time_by(distinct_rows(in_week(media, start, end, "started_at")), track)


def weekly_total(df: DataFrame, start: dt.date | str, end: dt.date | str | None = None) -> DataFrame:
    """One row: seconds in a range of days, exact duplicates counted once as in the daily sums."""
    return distinct_rows(in_week(df, start, end, "started_at")).agg(
        F.coalesce(F.sum("duration_seconds"), F.lit(0)).alias("total_seconds"))


def weekly_report(facts: dict[str, DataFrame], start: dt.date | str, rules: DataFrame,
                  end: dt.date | str | None = None) -> DataFrame:
    """A week as rows `metric, key, value`: per application, site, track and day, total, score.

    Media are classed by title and artist, as a day's are; the player is in the track's key only.
    """
    cells = classify_activity(spent(facts, lambda df: in_week(df, start, end, "started_at")), rules)
    kind = F.col("kind")

    def entry(metric: str, key: Column | str) -> Column:
        return F.struct(F.lit(metric).alias("metric"), (F.lit(key) if isinstance(key, str) else key).alias("key"))

    entries = (F.when(kind == "app", F.array(entry("app_seconds", F.col("name")), entry("day_seconds", F.col("day").cast("string")),
                                             entry("day_seconds", "total"), entry("", F.col("activity"))))
               .when(kind == "domain", F.array(entry("website_seconds", F.col("name")), entry("", F.col("activity"))))
               .otherwise(F.array(entry("media_seconds", F.col("track")), entry("", F.col("activity")))))
    sums = cells.select(F.explode(entries).alias("_e"), "total_seconds").groupBy("_e.metric", "_e.key").agg(
        F.sum("total_seconds").alias("total_seconds"))
    score = _score(sums.where("metric = ''").withColumnRenamed("key", "activity"))
    return sums.where("metric <> ''").select("metric", "key", F.col("total_seconds").cast("double").alias("value")).unionByName(
        score.select(F.lit("productivity_score").alias("metric"), F.lit(None).cast("string").alias("key"), F.col("score").alias("value")))


def shift_summary(df: DataFrame, day: dt.date | str) -> DataFrame:
    """Seconds and events of a day per shift and category, with totals where these are NULL.

    The rollup multiplies the few rows per shift and category, not the events.
    """
    cells = on_date(df, day).groupBy(shift_id(F.col("timestamp")).alias("shift_id"), "category").agg(
        F.sum("duration_seconds").alias("_seconds"), F.count("*").alias("_events"))
    return cells.rollup("shift_id", "category").agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("_seconds").alias("total_seconds"), F.sum("_events").alias("events"))


def weekly_update_day(df: DataFrame, week_start: dt.date | str, threshold_hours: float = 20.0) -> DataFrame:
    """One row: the weekday (Monday 0) to run the weekly job on, by Friday's hours."""
    monday = dt.date.fromisoformat(str(week_start)) if isinstance(week_start, str) else week_start
    friday = monday + dt.timedelta(days=4)
    hours = F.coalesce(F.sum("duration_seconds"), F.lit(0)) / 3600
    return on_date(df, friday).agg(hours.alias("friday_hours")).withColumn(
        "update_day", F.when(F.col("friday_hours") >= threshold_hours, 4).otherwise(5))


def first_event_date(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.agg(F.min(ts).cast("date").alias("first_date"))


def volume_check(files: DataFrame, min_bytes: int = 10_000_000) -> DataFrame:
    """One row: bytes of a file listing and whether they are enough for a report."""
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).withColumn(
        "enough", F.col("bytes") >= min_bytes)
