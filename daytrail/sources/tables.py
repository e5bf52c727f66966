"""The events table: scan, append, idempotent load, dead letters, archive, schema check."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrail.functions.timeparts import date_lit, log_timestamp, timestamp_lit
from daytrail.operators.sequence import dedupe_events
from daytrail.operators.unified import KEY_SEPARATOR
from daytrail.schemas import EVENT_COLUMNS, EVENT_IDENTITY, EVENTS_DDL, OWNER_COLUMNS


def read_usage_events(spark: SparkSession, path: str, event_type: str | None = None,
                      since: dt.datetime | str | None = None) -> DataFrame:
    """Events of a type since a time; both reach the scan, the time also as a partition filter."""
    df = spark.read.schema(EVENTS_DDL).parquet(path)
    if event_type is not None:
        df = df.where(F.col("type") == event_type)
    if since is not None:
        moment = dt.datetime.fromisoformat(since) if isinstance(since, str) else since
        df = df.where((F.col("event_date") >= date_lit(moment.date()))
                      & (F.col("timestamp") >= timestamp_lit(moment)))
    return df


def usage_key() -> Column:
    """Idempotency key of an events row among those of its user."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in EVENT_COLUMNS if c != "timestamp"]
    return F.md5(F.concat_ws(KEY_SEPARATOR, log_timestamp(F.col("timestamp")), *fields))


def table_rows(df: DataFrame, ingest_time: Column) -> DataFrame:
    """Loadable events as rows of the table; `id` and `user_id` are null where the frame has none."""
    owner = [(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in OWNER_COLUMNS.items()]
    return df.select(
        usage_key().alias("event_key"), *EVENT_COLUMNS, ingest_time.alias("created_at"), *owner,
        F.col("timestamp").cast("date").alias("event_date"))


def load_events(df: DataFrame, path: str, ingest_time: Column) -> None:
    """Append loadable events."""
    _append(table_rows(df, ingest_time), path)


def _append(rows: DataFrame, path: str) -> None:
    """Rows of a day meet in few files; the adaptive planner splits the tasks of a large day. Files
    are sorted, so that row groups can be skipped."""
    rows.hint("rebalance", "event_date").sortWithinPartitions("event_date", "type", "timestamp").write.mode(
        "append").partitionBy("event_date").parquet(path)


def new_rows(batch: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of a batch the table does not have, each once."""
    # One partitioning for the ranking, the known keys and the join.
    return unknown_rows(dedupe_events(batch, EVENT_IDENTITY, ["created_at", "id"]), table)


def unknown_rows(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows the table does not have. A missing user is one user."""
    known = table.select(*[F.col(c).alias(f"_{c}") for c in EVENT_IDENTITY]).distinct()
    return rows.join(known, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in EVENT_IDENTITY], "left_anti")


def touched_days(df: DataFrame, table: DataFrame, most: int = 10_000) -> DataFrame:
    """The table's partitions of the days in `df`, so that one stray old row costs one more day.

    Days are few: at most one for each partition of the table. Above `most`, all from the first to the last are taken.
    """
    days = sorted(r[0] for r in df.select("event_date").distinct().limit(most + 1).collect() if r[0] is not None)
    if len(days) > most:
        first, last = df.agg(F.min("event_date"), F.max("event_date")).first()
        return table.where(F.col("event_date").between(date_lit(first), date_lit(last)))
    return table.where(F.col("event_date").isin(*map(date_lit, days)) if days else F.lit(False))


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared file system, if it is there."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def upsert_events(df: DataFrame, path: str, ingest_time: Column) -> None:
    """Append only events the table lacks; loading the same events again changes nothing."""
    spark = df.sparkSession
    rows = table_rows(df, ingest_time)
    if table_exists(spark, path):
        rows = new_rows(rows, touched_days(rows, read_usage_events(spark, path)))
    else:
        rows = dedupe_events(rows, EVENT_IDENTITY, ["created_at", "id"])
    _append(rows, path)


def reject_rows(rejects: DataFrame, source: str, rejected_at: Column) -> DataFrame:
    """Dead-letter rows: the line, where it came from, and what is wrong with it."""
    raw = F.col("raw_line") if "raw_line" in rejects.columns else F.to_json(F.struct(*rejects.columns))
    return rejects.select(raw.alias("raw"), F.lit(source).alias("source"), "reasons",
                          rejected_at.alias("rejected_at"))


def write_rejects(rejects: DataFrame, path: str, source: str, rejected_at: Column, mode: str = "append"
                  ) -> None:
    reject_rows(rejects, source, rejected_at).write.mode(mode).parquet(path)


def check_table_schema(spark: SparkSession, actual: DataFrame | None, expected_ddl: str = EVENTS_DDL
                       ) -> DataFrame:
    """Differences between a table and its expected columns: `column_name, problem`; none when fine.

    `actual` None stands for a missing table.
    """
    expected = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], expected_ddl).schema}
    found = None if actual is None else {f.name: f.dataType.simpleString() for f in actual.schema}
    if found is None:
        problems = [("*", "table missing")]
    else:
        problems = [(c, "column missing") for c in expected if c not in found]
        problems += [(c, f"type {found[c]}, expected {t}") for c, t in expected.items() if c in found and found[c] != t]
        problems += [(c, "unexpected column") for c in found if c not in expected]
    return spark.createDataFrame(problems, "column_name STRING, problem STRING")


# The rules of the events table.
EVENT_RULES = {
    "type_not_null": "type IS NOT NULL",
    "timestamp_not_null": "timestamp IS NOT NULL",
    "type_known": "type IN ('app', 'web')",
    "app_name_length": "length(app_name) <= 255",
    "window_title_length": "length(window_title) <= 1000",
    "url_length": "length(url) <= 2000",
    "title_length": "length(title) <= 1000",
}
# Rules of our own: what the loading promises beyond those.
LOAD_RULES = {
    "event_key_not_null": "event_key IS NOT NULL",
    "duration_range": "duration_seconds BETWEEN 0 AND 86400",
    "event_date_of_timestamp": "event_date = CAST(timestamp AS DATE)",
}


def broken_rules(df: DataFrame, rules: dict[str, str] | None = None, by: Sequence[Column | str] = ()) -> DataFrame:
    """(`by`, rule, rows): how many rows break each rule, by file if `by` says so; rules that hold have no row.

    One pass over the columns the rules name. As with a CHECK constraint, a rule that is neither true nor false holds.
    """
    rules = rules or {**EVENT_RULES, **LOAD_RULES}
    counts = df.groupBy(*by).agg(*[F.count_if(~F.coalesce(F.expr(rule), F.lit(True))).alias(name) for name, rule in rules.items()])
    names = [c for c in counts.columns if c not in rules]
    return counts.unpivot(names, list(rules), "rule", "rows").where("rows > 0")


def drifted_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(column_name, kind, rows): values of a frame as it was delivered, such as a file of text, that are not of their column's kind."""
    bad = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull()).alias(c) for c, kind in kinds.items()]
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return df.agg(*bad).unpivot([], list(kinds), "column_name", "rows").where("rows > 0").select(
        "column_name", kind[F.col("column_name")].alias("kind"), "rows")


def archive_week(spark: SparkSession, path: str, archive: str, week_start: dt.date | str) -> None:
    """Move a week's rows to `archive/week=<start>`; the rest of the table is not touched.

    Rows the archive lacks are appended to it, and then the files that were read are deleted, no others. So
    a week with late rows can be archived again, and so can one whose job was cut off at any point.
    """
    start = dt.date.fromisoformat(str(week_start))
    target = f"{archive}/week={start.isoformat()}"
    days = [f"{path}/event_date={start + dt.timedelta(days=i)}" for i in range(7)]
    days = [day for day in days if table_exists(spark, day)]
    if not days:
        return
    files = spark.read.schema(EVENTS_DDL).option("basePath", path).parquet(*days).inputFiles()
    if not files:
        return
    rows = spark.read.schema(EVENTS_DDL).option("basePath", path).parquet(*files)
    if table_exists(spark, target):
        rows = unknown_rows(rows, read_usage_events(spark, target))
    _append(rows.select(*read_usage_events(spark, path).columns), target)
    for file in files:
        remove_path(spark, file)
