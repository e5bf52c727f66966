"""History joins, as-of lookups and store reconciliation.

No join carries a broadcast hint: Catalyst broadcasts a side whose measured size is below
`spark.sql.autoBroadcastJoinThreshold` and otherwise shuffles, and the adaptive skew join
splits a hot key's partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrail.functions.timeparts import chromium_ts, epoch_us, firefox_ts, timestamp_lit
from daytrail.functions.web import extract_domain, normalize_title, strip_browser_suffix
from daytrail.operators.filters import drop_blank_titles, web_urls_only
from daytrail.operators.ordered import HOT_ROWS, carry_last, hot_keys


def visit_seconds(duration: Column, unit: str = "us") -> Column:
    """Visit length in seconds; history stores microseconds (`us`), `raw` takes it as it is."""
    value = F.coalesce(duration, F.lit(0))
    return (F.floor(value / 1_000_000) if unit == "us" else value).cast("long")


def browser_history(visits: DataFrame, urls: DataFrame, since_us: int, duration_unit: str = "us",
                    read_at: Column | None = None) -> DataFrame:
    """Web events of the visits after `since_us`, without blank titles.

    `visits`: url (id), visit_time, visit_duration. `urls`: id, url, title.
    """
    recent = visits.where(F.col("visit_time") > since_us).withColumnRenamed("url", "_url_id")
    joined = recent.join(urls.select(F.col("id").alias("_url_id"), "url", "title"), "_url_id")
    kept = [c for c in visits.columns if c not in ("url", "visit_time", "visit_duration")]
    return drop_blank_titles(joined).select(
        *kept, F.lit("web").alias("type"), "url", "title",
        chromium_ts(F.col("visit_time"), read_at).alias("timestamp"),
        visit_seconds(F.col("visit_duration"), duration_unit).alias("duration_seconds"))


def poll_browsers(chromium: DataFrame, firefox: DataFrame, marks: DataFrame) -> DataFrame:
    """New web visits of several history sources.

    Both inputs: source, browser, url, title, visit_time in their own epoch. `marks`: source,
    marker in that epoch; a source without a mark is read from its start.
    """
    def fresh(rows: DataFrame, to_ts) -> DataFrame:
        marked = rows.join(marks, "source", "left")
        newer = marked.where(F.col("visit_time") > F.coalesce("marker", F.lit(0)))
        return web_urls_only(newer).select(
            "source", "browser", extract_domain(F.col("url")).alias("domain"), "url",
            F.col("title").alias("page_title"), to_ts(F.col("visit_time")).alias("visited_at"))

    return fresh(chromium, chromium_ts).unionByName(fresh(firefox, firefox_ts))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str,
          tie: str, values: Sequence[str], hot_rows: int = HOT_ROWS, split_by: Sequence[str] | None = None
          ) -> DataFrame:
    """Add struct `_match` with `values` of the newest right row at or before each left row.

    One shuffle of the two sides together; no pairs are formed. Equal times are in reach, and
    among right rows of one time the highest `tie` counts. Hot keys are looked for by `split_by`,
    which may leave out keys that are costly to compute. As in a join, a NULL key matches nothing.
    """
    row = F.struct(*left.columns)
    both = left.select(
        *keys, F.col(left_ts).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"),
        row.alias("_row"),
    ).unionByName(right.select(
        *keys, F.col(right_ts).alias("_at"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"),
        F.struct(*values, F.col(right_ts).alias("_at")).alias("_value"),
    ), allowMissingColumns=True)
    split_by = list(split_by or keys)
    # The hash tells rows of one time apart, of which there may be any number.
    places = left.select(*split_by, F.col(left_ts).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"),
                         F.xxhash64(*left.columns).alias("_row_hash")).unionByName(
        right.select(*split_by, F.col(right_ts).alias("_at"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"),
                     F.xxhash64(*right.columns).alias("_row_hash")))
    hot = hot_keys(places, split_by, ["_at", "_side", "_tie"], hot_rows)
    carried = carry_last(both, hot, keys, ["_at", "_side", "_tie"], "_value", "_match")
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return carried.where("_side = 1").select("_row.*", F.when(known, F.col("_match")).alias("_match"))


def _page_key(browser: str, title: str) -> Column:
    return normalize_title(strip_browser_suffix(F.col(browser), F.col(title)))


def infer_active_url(windows: DataFrame, visits: DataFrame, lookback_seconds: int,
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """URL of each browser window: the newest visit of the same title within the lookback.

    `windows`: user_id, browser, window_title, timestamp. `visits`: user_id, browser, title,
    url, timestamp, id.
    """
    left = windows.withColumn("_page", _page_key("browser", "window_title"))
    right = visits.withColumn("_page", _page_key("browser", "title"))
    found = as_of(left, right, ["user_id", "browser", "_page"], "timestamp", "timestamp", "id",
                  ["url"], hot_rows, split_by=["user_id", "browser"])
    near = epoch_us(F.col("timestamp")) - epoch_us(F.col("_match._at")) <= lookback_seconds * 1_000_000
    return found.withColumn("url", F.when(near, F.col("_match.url"))).drop("_match", "_page")


def infer_session_url(sessions: DataFrame, visits: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """URL of each session: the newest visit between its start and its end.

    That visit is the newest one up to the session's end, if it is not before the start; so the
    interval join needs no pairs.
    """
    found = as_of(sessions, visits, ["user_id", "browser"], "ended_at", "timestamp", "id", ["url"], hot_rows)
    inside = F.col("_match._at") >= F.col("started_at")
    return found.withColumn("url", F.when(inside, F.col("_match.url"))).drop("_match")


def reconcile(a: DataFrame, b: DataFrame, key: str = "event_key") -> DataFrame:
    """Keys that only one of two stores has: `missing_from` is `a` or `b`.

    Counted per task before the shuffle, so that many copies of a key do no harm.
    """
    tagged = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    sides = tagged.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return sides.where(F.col("_a") != F.col("_b")).select(
        key, F.when(F.col("_a") == 1, "b").otherwise("a").alias("missing_from"))


def missing_rows(have: DataFrame, other: DataFrame, key: str = "event_key") -> DataFrame:
    """Rows of `other` to append to `have` so that it has every key; of a key's rows the first by its columns."""
    order = [F.col(c) for c in other.columns if c != key] or [F.lit(0)]
    once = other.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rank = 1").drop("_rank")
    return once.join(have.select(key).distinct(), key, "left_anti")


def recent_urls(urls: DataFrame, since: str, n: int = 100) -> DataFrame:
    """Last visited URLs, newest first."""
    return urls.where(F.col("last_visit_time") > timestamp_lit(since)).orderBy(
        F.col("last_visit_time").desc(), "id").limit(n)
