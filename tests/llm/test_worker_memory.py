"""Python workers, which wait for later tasks, return the memory that a task no longer needs."""

from __future__ import annotations

import re
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from daytrail.llm import near_dedup, packing
from daytrail.llm.common import stored


def workers():
    """MB of memory of its own, by worker process."""
    found = {}
    for p in Path("/proc").glob("[0-9]*"):
        try:
            if b"pyspark.daemon" in (p / "cmdline").read_bytes():
                found[p.name] = sum(map(int, re.findall(r"\nPrivate_(?:Dirty|Clean):\s+(\d+)", (p / "smaps_rollup").read_text()))) / 1024
        except OSError:
            pass
    return found


@pytest.mark.parametrize("run, most", [
    (near_dedup.sketched, 95), (lambda docs: packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")), 130)], ids=["sketches", "pieces"])
def test_waiting_workers_hold_little(spark, run, most):
    """One task over 40 MB of text leaves its worker with little more than it had."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(700)), lambda i: F.substring(F.md5(F.concat_ws(" ", "id", i)), 1, 4)), " ")
    docs = stored(spark.range(10_000).select(F.col("id").alias("doc_id"), text.alias("text")).coalesce(1), "texts")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1g")
    try:
        before = workers()
        run(docs).write.format("noop").mode("overwrite").save()
        grown = {pid: mb - before.get(pid, 0) for pid, mb in workers().items()}
        assert max(grown.values()) < most
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
