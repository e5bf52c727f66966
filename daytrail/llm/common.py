"""Helpers the operators share: tables, written intermediate results, words, prefix sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daytrail.session import scratch_dir

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries within go when the query ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """`df`, written to the shared scratch folder and read from there.

    This cuts the lineage: a lost executor costs no more than its own reads. The write's shuffle files, which nothing reads again, go with it.
    """
    path = scratch_dir(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow; at a task's end Arrow returns what it holds free.

    A Python worker waits for later tasks, also through stages that use none, and would keep its largest task's memory until then.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return task


def words(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def with_start(df: DataFrame, group: str | None, bucket: str, order: list[str], size: str, start: str) -> DataFrame:
    """Add `start`: the sum of `size` over the earlier rows of the row's group (of all rows if None).

    Rows come by (bucket, order). A group may hold most rows, so no window spans one: rows are summed
    within (group, bucket), and one total for each bucket is summed within the group.
    """
    keys = ([group] if group else []) + [bucket]
    totals = df.groupBy(*keys).agg(F.sum(size).alias("__total"))
    over = Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy(bucket)
    totals = totals.withColumn("__before", F.sum("__total").over(over) - F.col("__total"))
    totals = totals.select(*[F.col(k).alias(f"__{k}") for k in keys], "__before")
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return (df.withColumn("__within", F.coalesce(F.sum(size).over(within), F.lit(0)))
            .join(totals, same).withColumn(start, F.col("__before") + F.col("__within"))
            .drop("__before", "__within", *[f"__{k}" for k in keys]))


def rereadable(df: DataFrame) -> DataFrame:
    """`df` if it is a plain read of files, else stored, so that its rows have addresses."""
    try:
        return addressed(df, F.lit(1)) and df
    except (AnalysisException, Py4JJavaError):
        return stored(df, "rows")


def addressed(df: DataFrame, *columns: Column) -> DataFrame:
    """`columns` of a `rereadable` frame with `__file` and `__row`, the place in the files that a row comes from.

    They tell every row apart, equal rows too, and stay the same when a task runs again. The frame may have columns of these names
    of its own, and of the name of Spark's hidden column.
    """
    place = df.metadataColumn("_metadata")
    return df.select(*columns, F.xxhash64(place["file_path"]).alias("__file"), place["row_index"].alias("__row"))


def numbers(df: DataFrame, count: Column, name: str, chunk: int = 1 << 16) -> DataFrame:
    """Each row once for every 0 <= `name` < `count`, spread over tasks; no array gets longer than a chunk."""
    chunks = df.withColumn("__count", count).filter("__count > 0").withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("__count") - 1) / chunk))))
    first = F.col("__chunk") * chunk
    last = F.least(first + chunk - 1, F.col("__count") - 1)
    return chunks.repartition(F.col("__chunk")).withColumn(name, F.explode(F.sequence(first, last))).drop("__count", "__chunk")
