"""Stored frames leave no shuffle files, and components are found without a round too many."""

from __future__ import annotations

from daytrail.llm import near_dedup
from daytrail.llm.common import stored


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(found.apply(i).getName().startswith("shuffle_") for i in range(found.size()))


def test_stored_frames_leave_no_shuffle_files(spark):
    before, key = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    one = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    two = stored(one.join(spark.range(7).select(F.col("id").alias("k")).hint("merge"), "k"), "test")
    assert shuffle_files(spark) <= before and spark.conf.get(key) == setting and two.count() == 7


def test_stars_need_no_round(spark, monkeypatch):
    """Pairs and stars are components as they are; a chain takes rounds until it is a star, and none to see that."""
    names = []
    monkeypatch.setattr(near_dedup, "stored", lambda df, name: names.append(name) or stored(df, name))
    links = spark.createDataFrame([(1, 2), (1, 3), (9, 8), (4, 4)], "a LONG, b LONG")
    assert sorted(map(tuple, near_dedup.components(links).collect())) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)] and names == ["edges"]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a LONG, b LONG")
    assert {r.root for r in near_dedup.components(chain).collect()} == {0} and 2 < len(names) < 9
