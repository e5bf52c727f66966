"""Streaming forms of de-duplication, change detection, sessions and the daily summary.

Watermarks need TIMESTAMP, so event times are cast in and cast back out. A row later than the
watermark reaches no sink of the watermarked forms; a query's progress counts such rows.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from daytrail.operators.sequence import SIGNATURE, WINDOW
from daytrail.session import SETTINGS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_starting = threading.Lock()


def _timed(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def dedupe_stream(df: DataFrame, delay: str, signature: Sequence[str] = (*SIGNATURE, "url"),
                  ts: str = "timestamp", salts: int = 32) -> DataFrame:
    """First row of each signature that arrives within the delay.

    A first pass tells rows apart by their task too, so that the copies of a frequent signature
    are dropped in many places; the second pass sees a few rows of each.
    """
    salted = _timed(df, ts, delay).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    few = salted.dropDuplicatesWithinWatermark([*signature, "_salt"]).drop("_salt")
    return few.dropDuplicatesWithinWatermark(list(signature)).withColumn(ts, F.col(ts).cast("timestamp_ntz"))


def session_stream(df: DataFrame, gap: str, delay: str, keys: Sequence[str] = ("user_id", *WINDOW),
                   ts: str = "timestamp") -> DataFrame:
    """Sessions of each window: rows no further apart than the gap."""
    return _timed(df, ts, delay).groupBy(F.session_window(ts, gap).alias("_w"), *keys).agg(
        F.min(ts).cast("timestamp_ntz").alias("started_at"),
        F.max(ts).cast("timestamp_ntz").alias("ended_at"),
        F.count("*").alias("n_events"), F.sum("duration_seconds").alias("duration_seconds")).drop("_w")


def daily_summary_stream(df: DataFrame, delay: str, ts: str = "timestamp") -> DataFrame:
    """Events, applications and URLs per day and type; distinct counts are approximate."""
    return _timed(df, ts, delay).groupBy(F.window(ts, "1 day").alias("_w"), "type").agg(
        F.count("*").alias("event_count"),
        F.approx_count_distinct("app_name").alias("unique_apps"),
        F.approx_count_distinct("url").alias("unique_urls"),
    ).select(F.col("_w.start").cast("date").alias("date"), "type", "event_count", "unique_apps", "unique_urls")


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what there is and append it to a Parquet folder.

    A query copies its session's settings when it starts. So its state is outside of the heap, which `changed_only_stream` needs,
    on any session, whose own setting is as before afterwards. A checkpoint goes on with the store it was begun with.
    """
    writer = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option(
        "path", path).trigger(availableNow=True)
    conf = df.sparkSession.conf
    with _starting:
        before = conf.get(_PROVIDER, None)
        conf.set(_PROVIDER, SETTINGS[_PROVIDER])
        try:
            return writer.start()
        finally:
            conf.unset(_PROVIDER) if before is None else conf.set(_PROVIDER, before)


class _LastRow(StatefulProcessor):
    """Passes a chunk's first row on if it differs from the last row of the chunk before, and rows from within chunks as they are.

    State is the last row's `same` of each key that has had a chunk, and only keys of the batch are looked up.
    """

    def __init__(self, columns: list[str], state: StructType):
        self.columns, self.state = columns, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.state)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        firsts = []
        for row in rows:
            if row["_first"]:
                firsts.append(row)  # one for each chunk that has ended
            else:
                yield self.out(row)
        if not firsts:
            return
        firsts.sort(key=lambda row: row["_end"])
        n = len(self.state.fields)
        before = tuple(self.last.get()) if self.last.exists() else None
        for row in firsts:
            if before != tuple(row[f"_open{i}"] for i in range(n)):
                yield self.out(row)
            before = tuple(row[f"_close{i}"] for i in range(n))
        self.last.update(before)

    def out(self, row: Row) -> Row:
        return Row(**{c: row[c] for c in self.columns})

    def close(self) -> None:
        pass


def changed_only_stream(df: DataFrame, delay: str, chunk: str = "10 minutes", same: Sequence[str] = WINDOW,
                        keys: Sequence[str] = ("user_id",), ts: str = "timestamp",
                        order: Sequence[str] = ("timestamp", "id"), spread: int = 64) -> DataFrame:
    """Continuous change detection: rows that differ in `same` from the key's row before them.

    Rows wait until the watermark, `delay` behind the newest row, has passed their chunk of time; so rows that come late, but not by more,
    are compared in their place, as in the batch form. A chunk's rows are compared with each other where they are grouped; only its
    first and last row go to the key's state, so that a busy key sends one row a chunk to its task. Rows within chunks are spread.

    A row later than the watermark, or without a time, reaches no sink. Keys that never come again keep their last row.
    The state store must be RocksDB's, which `run_to_table` sees to; other sinks need a session with the settings of `build_session`.
    """
    columns, keys = df.columns, list(keys)
    fields = {f.name: f for f in df.schema.fields}
    row = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*columns).alias("row"))
    timed = df.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", delay)
    chunks = timed.groupBy(F.window("_at", chunk).alias("_w"), *keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))

    def of(x: Column) -> list[Column]:
        return [x["row"][c] for c in same]

    def begins(x: Column, i: Column) -> Column:
        return (i == 0) | ~F.struct(*of(x)).eqNullSafe(F.struct(*of(F.get("_rows", i - 1))))

    ends = {f"_{end}{i}": c for end, k in (("open", 1), ("close", -1)) for i, c in enumerate(of(F.element_at("_rows", k)))}
    listed = chunks.select("_w.end", *[c.alias(name) for name, c in ends.items()],
                           F.posexplode(F.filter("_rows", begins)).alias("_k", "_r"))
    first = F.col("_k") == 0
    flat = listed.select(
        *[F.col("_r.row")[c].alias(c) for c in columns], F.col("end").alias("_end"), *ends, first.alias("_first"),
        F.when(first, F.lit(0)).otherwise(1 + F.col("_k") % spread).alias("_part"))
    state = StructType([fields[c] for c in same])
    return flat.groupBy(*keys, "_part").transformWithState(_LastRow(columns, state), df.schema, "append", "none")
