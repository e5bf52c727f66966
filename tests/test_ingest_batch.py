"""What a batch of lines holds while it is loaded, and that nothing is lost by it."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from daytrail.functions.timeparts import timestamp_lit
from daytrail.sources import lines, tables
from daytrail.streaming import ingest

NOW = "2026-04-24 12:00:00"


@pytest.fixture
def feed(spark):
    """Lines of both types, twice each, with every seventh a reject."""
    def line(i):
        app = {"type": "app", "app_name": f"a{i}", "window_title": f"w{i} password=x{i}", "process_id": i}
        web = {"type": "web", "url": f"https://e.com/{i}?token=t{i}", "title": f"t{i}", "visit_duration": i}
        event = {**(web if i % 2 else app), "timestamp": f"2026-04-{1 + i % 20:02d}T10:00:00", "id": i, "user_id": i % 3}
        return "{broken" if i % 14 == 0 else json.dumps(event | ({"timestamp": "yesterday"} if i % 7 == 0 else {}))

    text = [(line(i),) for i in range(200)] * 2
    return lines.parse_event_lines(spark.createDataFrame(text, "value STRING").repartition(3))


def stored(spark):
    return {i: rdd.getStorageLevel() for i, rdd in spark.sparkContext._jsc.getPersistentRDDs().items()}


def test_no_row_of_a_batch_is_kept_in_memory(spark, feed, tmp_path, monkeypatch):
    before, during, real = stored(spark), {}, ingest.write_rejects
    monkeypatch.setattr(ingest, "write_rejects", lambda *a, **k: (real(*a, **k), during.update(stored(spark)))[0])
    ingest.ingest_batch(feed, str(tmp_path / "events"), str(tmp_path / "rejects"), NOW)
    levels = [level for i, level in during.items() if i not in before]
    assert levels and all(level.useDisk() and not level.useMemory() for level in levels)
    assert set(stored(spark)) <= set(before)


def test_a_line_is_kept_for_rejects_only(feed):
    checked = ingest.check_lines(feed)
    kept = ingest.needed_fields(checked)
    accepted = F.size("reasons") == 0
    fields = [c for c in kept.columns if c not in ("raw_line", "reasons")]
    assert kept.where(accepted & F.col("raw_line").isNotNull()).isEmpty()
    assert kept.where(~accepted & F.coalesce(*[F.col(c).cast("string") for c in fields]).isNotNull()).isEmpty()
    assert kept.where(~accepted).select("raw_line", "reasons").exceptAll(checked.where(~accepted).select("raw_line", "reasons")).isEmpty()
    assert checked.where(accepted).select(fields).exceptAll(kept.where(accepted).select(fields)).isEmpty()
    assert kept.count() == checked.count()


def test_batch_loads_and_rejects_all_its_lines(spark, feed, tmp_path):
    path, rejects, at = str(tmp_path / "events"), str(tmp_path / "rejects"), timestamp_lit(NOW)
    for _ in range(2):
        ingest.ingest_batch(feed, path, rejects, NOW)
    valid, bad = ingest.clean_lines(feed, at)
    want = tables.table_rows(valid, at).dropDuplicates(["user_id", "event_key"])
    got = tables.read_usage_events(spark, path).select(want.columns)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() == 171
    lost = tables.reject_rows(bad, "stream", at)
    found = spark.read.parquet(rejects).select(lost.columns)
    assert found.exceptAll(lost).isEmpty() and found.count() == lost.count() == 58


def test_rejects_without_their_line_are_whole(spark, feed, tmp_path):
    ingest.ingest_batch(feed.drop("raw_line"), str(tmp_path / "events"), str(tmp_path / "rejects"), NOW)
    raw = [json.loads(r.raw) for r in spark.read.parquet(str(tmp_path / "rejects")).where("reasons[0] = 'timestamp_invalid'").collect()]
    assert len(raw) == 28 and {"id", "user_id", "url", "malformed"} <= set().union(*raw)
