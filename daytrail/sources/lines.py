"""Event lines, structured logs and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrail.operators.unified import normalize_event, parse_log_lines, structured_line
from daytrail.schemas import RAW_DDL, RAW_FIELDS


def parse_event_lines(lines: DataFrame) -> DataFrame:
    """Raw events of JSON lines (column `value`); blank lines are skipped.

    `malformed` marks a line that is no JSON object. `raw_line` is the line itself.
    """
    parsed = lines.where(F.col("value").rlike(r"[^\s]")).select(
        F.col("value").alias("raw_line"),
        F.from_json("value", RAW_DDL + ", _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"}).alias("_e"))
    malformed = F.col("_e").isNull() | F.col("_e._corrupt").isNotNull() | ~F.trim("raw_line").startswith("{")
    return parsed.withColumn("malformed", malformed).select(
        "raw_line", *[F.when(~F.col("malformed"), F.col(f"_e.{f}")).alias(f) for f in RAW_FIELDS], "malformed")


def read_event_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_event_lines(spark.read.text(path))


def stream_event_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A continuous feed of the JSON-line files that arrive in a folder."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_event_lines(reader.load(path))


def event_lines(raw: DataFrame) -> DataFrame:
    """JSON lines of raw events; missing fields are left out."""
    return raw.select(F.to_json(F.struct(*[c for c in raw.columns if c in RAW_FIELDS])).alias("value"))


def read_structured_log(spark: SparkSession, path: str) -> DataFrame:
    """Unified rows of a log; lines that are no event are left out."""
    lines = parse_log_lines(spark.read.text(path))
    return normalize_event(lines.where(F.col("event_type").isNotNull()))


def write_structured_log(df: DataFrame, path: str, mode: str = "append") -> None:
    df.select(structured_line(df).alias("value")).write.mode(mode).text(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths and sizes of the files under a folder; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option(
        "recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def source_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files and lines per folder of legacy sources."""
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    name = F.col("_metadata.file_path")
    per_file = lines.select(name.alias("file")).groupBy("file").agg(F.count("*").alias("n"))
    folder = F.element_at(F.split(F.regexp_replace("file", r"/[^/]*$", ""), "/"), -1)
    return per_file.groupBy(folder.alias("source")).agg(
        F.count("*").alias("files"), F.sum("n").alias("lines"))
