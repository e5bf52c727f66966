from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from daytrail.functions.timeparts import timestamp_lit
from daytrail.operators import validation
from daytrail.schemas import EVENTS_DDL, RAW_FIELDS
from daytrail.sources import files, lines, tables
from daytrail.streaming import ingest

NOW = "2026-04-24 12:00:00"
APP = {"type": "app", "app_name": "VS Code", "window_title": "main.py", "process_id": 1, "timestamp": "2026-04-24T10:00:00"}
WEB = {"type": "web", "url": "https://github.com", "title": "Repo", "timestamp": "2026-04-24T10:05:00", "duration_seconds": 600}


@pytest.fixture
def parse(spark):
    def run(*events):
        text = [(e if isinstance(e, str) else json.dumps(e),) for e in events]
        return lines.parse_event_lines(spark.createDataFrame(text, "value STRING"))

    return run


@pytest.fixture
def clean(parse):
    def run(*events, default_type=None):
        valid, rejects = ingest.clean_lines(parse(*events), timestamp_lit(NOW), default_type)
        return valid.collect(), rejects.collect()

    return run


def without(event, *keys, **changes):
    return {k: v for k, v in event.items() if k not in keys} | changes


@pytest.mark.parametrize("event,reasons", [
    (APP, []),
    (WEB, []),
    (without(APP, "app_name"), ["app_name_missing"]),
    (without(APP, app_name=""), []),
    (without(APP, app_name="x" * 255), []),
    (without(APP, app_name="x" * 256), ["app_name_too_long"]),
    (without(APP, app_name="😀" * 255), []),
    (without(APP, window_title=None), []),
    (without(APP, window_title="x" * 1001), ["window_title_too_long"]),
    (without(APP, process_id="x"), ["process_id_invalid"]),
    (without(APP, "timestamp"), ["timestamp_invalid"]),
    (without(APP, timestamp="yesterday"), ["timestamp_invalid"]),
    (without(APP, type="app_v2"), ["type_unknown"]),
    (without(APP, "type"), ["type_unknown"]),
    (without(WEB, "url"), ["url_missing"]),
    (without(WEB, url="ftp://example.com"), ["url_scheme"]),
    (without(WEB, url="HTTPS://example.com"), ["url_scheme"]),
    (without(WEB, url="https://" + "x" * 1993), ["url_too_long"]),
    (without(WEB, title="x" * 1001), ["title_too_long"]),
    (without(WEB, duration_seconds=86400), []),
    (without(WEB, duration_seconds=86401), ["duration_invalid"]),
    (without(WEB, duration_seconds=-1), ["duration_invalid"]),
    (without(WEB, duration_seconds=1.5), ["duration_invalid"]),
    (without(WEB, duration_seconds=60.0), []),
    (without(WEB, duration_seconds=None), []),
    (without(WEB, "duration_seconds"), []),
    ("{broken", ["malformed_json"]),
    ("[1]", ["malformed_json"]),
    ('"text"', ["malformed_json"]),
])
def test_reasons(clean, event, reasons):
    valid, rejects = clean(event)
    assert [r.reasons for r in rejects] == ([reasons] if reasons else [])
    assert len(valid) == (0 if reasons else 1)


def test_default_type(clean):
    valid, rejects = clean(without(APP, "type"), default_type="app")
    assert len(valid) == 1 and not rejects


def test_blank_lines_are_skipped(parse):
    assert parse("", "   ", APP).count() == 1


def test_browser_aliases_are_normalized(clean):
    [row], _ = clean({"type": "web", "url": "https://e.com", "title": "t", "visit_time": "2026-04-24T10:00:00", "visit_duration": 300})
    assert (str(row.timestamp), row.duration_seconds) == ("2026-04-24 10:00:00", 300)


def test_redaction_and_defaults(clean):
    rows, _ = clean(without(APP, window_title="Secret: password=1234 - MyWindow"), without(APP, "window_title"),
                    without(WEB, "title", url="https://example.com/login?user=john&password=secret"))
    by_url = {(r.type, r.window_title, r.url): r for r in rows}
    assert ("app", "[REDACTED] - MyWindow", None) in by_url
    assert ("app", "", None) in by_url
    web = by_url["web", None, "https://example.com/login?user=john&redacted=%5BREDACTED%5D"]
    assert (web.app_name, web.title, web.duration_seconds) == ("Chrome", "", 600)


def test_split_is_a_partition(spark, small):
    from checks.bindings import bind

    raw = bind(spark, small, "raw_events")
    valid, rejects = validation.split_valid(validation.validate_events(validation.normalize_web(raw)))
    assert valid.count() + rejects.count() == raw.count()
    assert valid.select("id").intersect(rejects.select("id")).isEmpty()


def test_load_is_idempotent_and_purely_additive(spark, parse, tmp_path):
    path, at = str(tmp_path / "events"), timestamp_lit(NOW)
    events, _ = ingest.clean_lines(parse(APP, APP, WEB), at)
    tables.upsert_events(events, path, at)
    tables.upsert_events(events, path, at)
    more, _ = ingest.clean_lines(parse(APP, without(WEB, timestamp="2026-04-25T10:00:00")), at)
    tables.upsert_events(more, path, at)
    assert tables.read_usage_events(spark, path).count() == 3
    assert tables.read_usage_events(spark, path, "web", "2026-04-25").count() == 1
    assert tables.check_table_schema(spark, tables.read_usage_events(spark, path)).isEmpty()


def test_scan_prunes_partitions_and_columns(spark, parse, tmp_path):
    path, at = str(tmp_path / "events"), timestamp_lit(NOW)
    tables.load_events(ingest.clean_lines(parse(APP, WEB), at)[0], path, at)
    df = tables.read_usage_events(spark, path, "web", "2026-04-24 10:00:00").select("url")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "EqualTo(type,web)" in plan
    assert "ReadSchema: struct<type:string,url:string,timestamp:timestamp_ntz>" in plan


def test_schema_differences(spark):
    df = spark.createDataFrame([], EVENTS_DDL.replace("duration_seconds INT", "duration_seconds STRING")).drop("url").withColumn("x", F.lit(1))
    got = {tuple(r) for r in tables.check_table_schema(spark, df).collect()}
    assert got == {("url", "column missing"), ("duration_seconds", "type string, expected int"), ("x", "unexpected column")}
    assert tables.check_table_schema(spark, None).first().problem == "table missing"


def test_rejects_round_trip(spark, parse, tmp_path):
    _, rejects = ingest.clean_lines(parse(without(APP, "app_name"), "{oops"), timestamp_lit(NOW))
    tables.write_rejects(rejects, str(tmp_path / "r"), "file", timestamp_lit(NOW))
    got = {r.raw: r.reasons for r in spark.read.parquet(str(tmp_path / "r")).collect()}
    assert got["{oops"] == ["malformed_json"] and ["app_name_missing"] in got.values()


def test_export_writes_nothing_without_rows(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "app", "=cmd", None, "2026-04-24 10:00:00", 300), (2, "app", "x,\"y\"", "t", "2026-04-25 10:00:00.5", None)],
        "id LONG, type STRING, app_name STRING, window_title STRING, timestamp STRING, duration_seconds INT"
    ).withColumns({"timestamp": F.col("timestamp").cast("timestamp_ntz"), "url": F.lit(None).cast("string"), "title": F.lit(None).cast("string")})
    out = str(tmp_path / "export")
    assert not files.export_usage_csv(df, "web", "2026-04-26", out)
    assert not (tmp_path / "export").exists()
    assert files.export_usage_csv(df, "app", "2026-04-26", out)
    folder = tmp_path / "export" / "app_usage" / "export_date=2026-04-26"
    import gzip

    text = [gzip.open(p, "rt").read() for p in sorted(folder.glob("*.csv.gz"))]
    body = [line for t in text for line in t.splitlines()[1:]]
    assert body == ['2,"x,""y""",t,2026-04-25 10:00:00.500000,', "1,'=cmd,,2026-04-24 10:00:00,300"]
    assert text[0].splitlines()[0] == "id,app_name,window_title,timestamp,duration_seconds"


def test_stream_equals_batch(spark, parse, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.jsonl").write_text("\n".join([json.dumps(APP), json.dumps(WEB), "{bad", ""]))
    def run():
        ingest.ingest_stream(spark, str(src), str(tmp_path / "events"), str(tmp_path / "rejects"),
                             str(tmp_path / "checkpoint"), NOW, max_files=1).awaitTermination()
    run()
    (src / "b.jsonl").write_text("\n".join([json.dumps(APP), json.dumps(without(APP, app_name="x")), json.dumps(without(WEB, "url"))]))
    run()
    got = tables.read_usage_events(spark, str(tmp_path / "events"))
    batch, _ = ingest.clean_lines(lines.read_event_lines(spark, str(src)), timestamp_lit(NOW))
    want = tables.table_rows(batch, timestamp_lit(NOW)).dropDuplicates(["event_key"])
    assert got.select("event_key").exceptAll(want.select("event_key")).isEmpty() and got.count() == want.count() == 3
    rejects = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "rejects"))
    assert sorted(r.reasons[0] for r in rejects.collect()) == ["malformed_json", "url_missing"]


def test_archive_week_can_run_again(spark, tmp_path):
    rows = spark.range(20).select(
        F.lit("app").alias("type"), F.lit("a").alias("app_name"), F.lit("w").alias("window_title"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("title"), F.timestamp_add("DAY", F.col("id"), timestamp_lit("2026-03-10")).alias("timestamp"),
        F.lit(1).alias("duration_seconds"))
    path, archive = str(tmp_path / "t"), str(tmp_path / "a")
    tables.load_events(rows, path, timestamp_lit(NOW))
    tables.archive_week(spark, path, archive, "2026-03-16")
    tables.archive_week(spark, path, archive, "2026-03-16")  # as after a failure: the copy stays whole
    assert tables.read_usage_events(spark, path).count() == 13
    assert tables.read_usage_events(spark, archive + "/week=2026-03-16").count() == 7


def test_archive_keeps_late_rows(spark, parse, tmp_path):
    path, archive, at = str(tmp_path / "t"), str(tmp_path / "a"), timestamp_lit(NOW)
    def load(*rows):
        tables.upsert_events(ingest.clean_lines(parse(*rows), at)[0], path, at)
        tables.archive_week(spark, path, archive, "2026-04-20")
    load(APP, WEB, dict(APP, timestamp="2026-04-28T10:00:00"))
    load(dict(APP, window_title="late"), APP)  # one row is new, one was archived before
    assert tables.read_usage_events(spark, archive + "/week=2026-04-20").count() == 3
    assert tables.read_usage_events(spark, path).count() == 1


def test_blank_lines_are_no_rejects(spark):
    got = lines.parse_event_lines(spark.createDataFrame([("\t",), (" ",), ("",), ("x",)], "value STRING")).collect()
    assert [(r.raw_line, r.malformed) for r in got] == [("x", True)]


def test_raw_fields_are_text():
    assert "timestamp" in RAW_FIELDS and len(RAW_FIELDS) == 12
