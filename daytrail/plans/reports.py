"""Warehouse reports over the events table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrail.functions.privacy import csv_safe
from daytrail.functions.timeparts import epoch_us
from daytrail.operators.filters import by_type, within_days
from daytrail.operators.lifecycle import RETENTION_DAYS
from daytrail.session import scratch_dir


def _seconds() -> Column:
    return F.coalesce("duration_seconds", F.lit(0))


def app_usage_stats(df: DataFrame, as_of: dt.datetime | str, days: int = 7) -> DataFrame:
    """Sessions and time per application, most used first; the mean is a whole number."""
    return within_days(by_type(df, "app"), as_of, days).groupBy("app_name").agg(
        F.count("*").alias("session_count"),
        F.sum(_seconds()).alias("total_seconds"),
        F.expr("sum(coalesce(duration_seconds, 0)) div count(*)").alias("avg_seconds"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    ).orderBy(F.col("total_seconds").desc(), "app_name")


def top_websites(df: DataFrame, as_of: dt.datetime | str, days: int = 7, n: int = 20) -> DataFrame:
    """Most visited URLs."""
    return within_days(by_type(df, "web"), as_of, days).groupBy("url").agg(
        F.count("*").alias("visit_count"),
        F.sum(_seconds()).alias("total_seconds"),
        F.max("timestamp").alias("last_visit"),
    ).orderBy(F.col("visit_count").desc(), "url").limit(n)


def daily_summary(df: DataFrame, as_of: dt.datetime | str, days: int = 30, approx: bool = False
                  ) -> DataFrame:
    """Events, applications and URLs per day and type.

    Rows are first counted per combination, so that the exact distinct counts work on far fewer
    rows than the events.
    """
    recent = within_days(df, as_of, days).withColumn("date", F.col("timestamp").cast("date"))
    if approx:
        return recent.groupBy("date", "type").agg(
            F.count("*").alias("event_count"),
            F.approx_count_distinct("app_name").alias("unique_apps"),
            F.approx_count_distinct("url").alias("unique_urls"),
        ).orderBy(F.col("date").desc(), "type")
    seen = recent.groupBy("date", "type", "app_name", "url").agg(F.count("*").alias("_n"))
    return seen.groupBy("date", "type").agg(
        F.sum("_n").alias("event_count"),
        F.count_distinct("app_name").alias("unique_apps"),
        F.count_distinct("url").alias("unique_urls"),
    ).orderBy(F.col("date").desc(), "type")


def event_stats(df: DataFrame) -> DataFrame:
    """One row: events in all and per type, and their time span."""
    return df.agg(
        F.count("*").alias("total_events"),
        F.count_if(F.col("type") == "app").alias("app_events"),
        F.count_if(F.col("type") == "web").alias("web_events"),
        F.min("timestamp").alias("oldest_event"),
        F.max("timestamp").alias("newest_event"))


# The export's columns and which of them are escaped.
EXPORT_COLUMNS = {
    "app": ["id", "app_name", "window_title", "timestamp", "duration_seconds"],
    "web": ["id", "app_name", "url", "title", "timestamp", "duration_seconds"],
}
ESCAPED_COLUMNS = {"app": ["app_name", "window_title"], "web": ["url", "title"]}


def usage_export_rows(df: DataFrame, kind: str, as_of: dt.datetime | str,
                      retention_days: int = RETENTION_DAYS) -> DataFrame:
    """Rows of an app or web export, unsorted."""
    recent = within_days(by_type(df, kind), as_of, retention_days, inclusive=False)
    return recent.select(*[csv_safe(F.col(c)).alias(c) if c in ESCAPED_COLUMNS[kind] else F.col(c)
                           for c in EXPORT_COLUMNS[kind]])


PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
_BAND = 0.001  # width of a value band in log scale: some 710 000 bands span every double
_BAND_SHIFT = 1_000_000  # keeps the bands of positive values positive
_ENDS = {"-inf": -3_000_000, "inf": 3_000_000, "nan": 4_000_000}  # bands of values without a logarithm, in Spark's order
_CELL_VALUES = 100_000  # distinct values that one task sorts
_CUTS, _ROUNDS = 1024, 6  # a band's doubles are told apart by 1024 ** 5 cuts


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _order_free_sum(x: Column) -> Column:
    """Sum of doubles. Where the largest is of usual size it is one of decimals, a coarse one and one of what that leaves, so
    that the order in which tasks finish does not show; else, also with values that are not finite, one of doubles."""
    usual = F.abs(x) < 1e18
    coarse = x.cast("decimal(28,6)")
    rest = (x - coarse.cast("double")).cast("decimal(38,28)")
    exact = F.sum(F.when(usual, coarse)).cast("double") + F.sum(F.when(usual, rest)).cast("double")
    return F.when((F.max(F.abs(x)) < 1e18) & (F.max(F.abs(x)) >= 1e-12), exact).otherwise(F.sum(x))


def _narrowed(values: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut cells of more than `_CELL_VALUES` distinct values by value until none is left; only the cells wanted stay.

    `values`: (group_key, _band, _cell, _v, _n). `wanted`: (group_key, _band, _cell, name, _rank).
    """
    cell = ["group_key", "_band", "_cell"]
    for _ in range(_ROUNDS):
        size = values.groupBy(*cell).agg(F.count("*").alias("_c"), F.min("_v").cast("double").alias("_lo"), F.max("_v").cast("double").alias("_hi"))
        if size.where(F.col("_c") > _CELL_VALUES).isEmpty():
            break
        share = F.coalesce(F.try_divide(F.col("_v").cast("double") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
        cut = values.join(size.drop("_c"), cell).withColumn(
            "_cell", F.col("_cell") * _CUTS + F.least(F.floor(share * _CUTS), F.lit(_CUTS - 1)).cast("long")).drop("_lo", "_hi")
        of = Window.partitionBy("group_key", "_band", "_outer").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        cells = cut.groupBy(*cell).agg(F.sum("_n").alias("_m")).withColumn("_outer", F.floor(F.col("_cell") / _CUTS).cast("long"))
        cells = cells.withColumn("_to", F.sum("_m").over(of)).withColumn("_from", F.col("_to") - F.col("_m"))
        outer = wanted.withColumnRenamed("_cell", "_outer")
        wanted = _kept(cells.join(outer, ["group_key", "_band", "_outer"]).where(
            (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).select(
            *cell, "name", (F.col("_rank") - F.col("_from")).alias("_rank")), "wanted")
        values = _kept(cut.join(wanted.select(*cell).distinct(), cell, "left_semi"), "values")
    return values, wanted


def latency_stats(df: DataFrame, value: str, ts: str, by: str | None = None, error: str | None = None
                  ) -> DataFrame:
    """Exact order statistics of a measure per group: the value at index floor(n * p).

    The rows of a group never meet in one task. A first count per value band, of which a group
    has a bounded number, finds the band each percentile is in; only those bands are counted by
    value, and cut further where they hold many. Infinite values and NaN count as Spark orders them.
    """
    key = F.col(by) if by else F.lit("all")
    rows = df.select(key.alias("group_key"), F.col(value).alias("_v"), F.col(ts).alias("_ts"),
                     (F.col(error) if error else F.lit(False)).alias("_e"))
    v = F.col("_v")
    band = F.when(v == 0, F.lit(0))
    for end, number in _ENDS.items():
        band = band.when(v.cast("double") == float(end), F.lit(number))
    band = band.otherwise(
        F.signum(v) * (F.floor(F.log(F.abs(v)) / _BAND) + _BAND_SHIFT)).cast("long")
    banded = rows.where(v.isNotNull()).withColumn("_band", band)
    bands = banded.groupBy("group_key", "_band").agg(F.count("*").alias("_n"))
    in_group = Window.partitionBy("group_key")
    before = in_group.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    placed = bands.withColumns({
        "_before": F.coalesce(F.sum("_n").over(before), F.lit(0)),
        "_all": F.sum("_n").over(in_group),
    })
    targets = placed.withColumn("_p", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.floor(F.col("_all") * p).alias("index"))
        for name, p in PERCENTILES.items()])))
    hit = targets.where((F.col("_p.index") >= F.col("_before"))
                        & (F.col("_p.index") < F.col("_before") + F.col("_n")))
    wanted = hit.select("group_key", "_band", "_p.name", (F.col("_p.index") - F.col("_before")).alias("_rank"))
    wanted = wanted.withColumn("_cell", F.lit(0).cast("long"))
    per_value = banded.join(wanted.select("group_key", "_band").distinct(), ["group_key", "_band"], "left_semi"
                            ).groupBy("group_key", "_band", "_v").agg(F.count("*").alias("_n"))
    per_value = per_value.withColumn("_cell", F.lit(0).cast("long"))
    per_value, wanted = _narrowed(_kept(per_value, "values"), _kept(wanted, "wanted"))
    upto = Window.partitionBy("group_key", "_band", "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = per_value.withColumn("_upto", F.sum("_n").over(upto))
    found = ranked.join(wanted, ["group_key", "_band", "_cell"]).where(
        (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
    quantiles = found.groupBy("group_key").agg(
        *[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in PERCENTILES])
    overall = rows.groupBy("group_key").agg(
        F.count("_v").alias("operations"),
        _order_free_sum(F.col("_v").cast("double")).alias("_sum"),
        F.max("_v").alias("max_value"),
        ((epoch_us(F.max("_ts")) - epoch_us(F.min("_ts"))) / 1_000_000).alias("total_seconds"),
        F.count_if("_e").alias("error_count"))
    return overall.join(quantiles, "group_key", "left").select(
        "group_key", "operations", "total_seconds",
        (F.col("operations") / F.greatest(F.col("total_seconds"), F.lit(0.001))).alias("per_second"),
        (F.col("_sum") / F.col("operations")).alias("avg_value"),
        *PERCENTILES, "max_value", "error_count")


SKETCH_BITS = 14
# Three standard errors of a HyperLogLog sketch of 2 ** SKETCH_BITS registers, which is 1.04 over the root of their number.
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


def daily_sketches(events: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Events, and sketches of the distinct applications and URLs, per day and type: rows to be stored once a day is over."""
    return events.groupBy(F.col(ts).cast("date").alias("date"), "type").agg(
        F.count("*").alias("event_count"), F.hll_sketch_agg("app_name", SKETCH_BITS).alias("apps"),
        F.hll_sketch_agg("url", SKETCH_BITS).alias("urls"))


def range_summary(sketches: DataFrame, first: dt.date | str, last: dt.date | str) -> DataFrame:
    """Events and distinct applications and URLs per type from `first` to `last`, by merging stored days.

    The counts of distinct values are estimates; SKETCH_ERROR of the count bounds their error in all but a few of a thousand cases.
    """
    days = sketches.where(F.col("date").between(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date")))
    return days.groupBy("type").agg(
        F.sum("event_count").alias("event_count"), F.hll_sketch_estimate(F.hll_union_agg("apps")).alias("unique_apps"),
        F.hll_sketch_estimate(F.hll_union_agg("urls")).alias("unique_urls"))
