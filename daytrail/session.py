"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library's plans rely on. The adaptive ones are Spark's defaults, spelled out because
# hot join keys are left to the adaptive skew join. Zone-free times are UTC, so the session is too.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # The JVM does not compile a method beyond this size; Spark then better leaves out the fusing
    # of a stage's operators, whose parts stay small.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Recording where in Python each column was made takes up much of the time to build a long query.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Streams keep their state outside of the heap, and merge sessions before they are shuffled.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(app_name: str = "daytrail", **extra: str) -> SparkSession:
    """A session with the settings above; `extra` takes further settings with `_` for `.`."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under the cluster's shared `spark.checkpoint.dir`.

    A machine-local folder is used only by a local master that has no such setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="daytrail-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
