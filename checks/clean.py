"""Sources, cleaning and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import duck
from checks.bindings import AS_OF, bind, given
from checks.registry import query
from daytrail.functions import privacy, timeparts, web
from daytrail.operators import validation
from daytrail.schemas import EVENTS_DDL
from daytrail.session import scratch_dir
from daytrail.sources import lines, tables

RAW_OUT = "id, type, app_name, window_title, process_id, url, title, timestamp, duration_seconds"


def _raw_lines(spark, sf):
    """JSON lines of the raw events, some of them cut off, and blank lines."""
    raw = bind(spark, sf, "raw_events")
    text = lines.event_lines(raw.withColumns({"process_id": F.col("id").cast("string"), "user_id": F.col("id") % 3}))
    cut = F.when(F.get_json_object("value", "$.process_id").cast("long") % 50 == 0,
                 F.substring(F.col("value"), F.lit(1), F.length("value") - 1)).otherwise(F.col("value"))
    return text.select(F.explode(F.array(cut, F.lit("  "))).alias("value"))


def _raw_with_id(spark, sf):
    """Raw rows as read back from lines, with the line's number kept as the process id."""
    path = scratch_dir(spark, "lines")
    _raw_lines(spark, sf).write.text(path)
    return lines.read_event_lines(spark, path)


@query("read_event_lines", needs=("raw_events",), sql="""
SELECT id % 50 = 0 AS malformed, CASE WHEN id % 50 <> 0 THEN CAST(id AS VARCHAR) END AS process_id,
  CASE WHEN id % 50 <> 0 THEN type END AS type, CASE WHEN id % 50 <> 0 THEN app_name END AS app_name,
  CASE WHEN id % 50 <> 0 THEN window_title END AS window_title, CASE WHEN id % 50 <> 0 THEN url END AS url,
  CASE WHEN id % 50 <> 0 THEN title END AS title, CASE WHEN id % 50 <> 0 THEN timestamp END AS timestamp,
  CASE WHEN id % 50 <> 0 THEN visit_time END AS visit_time,
  CASE WHEN id % 50 <> 0 THEN duration_seconds END AS duration_seconds,
  CASE WHEN id % 50 <> 0 THEN visit_duration END AS visit_duration, CASE WHEN id % 50 <> 0 THEN CAST(id AS VARCHAR) END AS id,
  CASE WHEN id % 50 <> 0 THEN CAST(id % 3 AS VARCHAR) END AS user_id FROM raw_events""")
def _(spark, sf):
    return _raw_with_id(spark, sf).drop("raw_line")


@query("normalize_web", needs=("raw_events",), ctes=duck.NORMALIZED, sql=f"SELECT {RAW_OUT} FROM normalized")
def _(spark, sf):
    return validation.normalize_web(bind(spark, sf, "raw_events"))


@query("validate_events", needs=("raw_events",), ctes=duck.VALIDATED, sql="SELECT id, reasons FROM validated")
def _(spark, sf):
    checked = validation.validate_events(validation.normalize_web(bind(spark, sf, "raw_events")))
    return checked.select("id", F.concat_ws(",", "reasons").alias("reasons"))


@query("split_valid", needs=("raw_events",), ctes=duck.VALIDATED,
       sql="SELECT id, CASE WHEN reasons = '' THEN 'valid' ELSE 'rejected' END AS outcome FROM validated")
def _(spark, sf):
    valid, rejects = validation.split_valid(
        validation.validate_events(validation.normalize_web(bind(spark, sf, "raw_events"))))
    return valid.select("id", F.lit("valid").alias("outcome")).unionByName(
        rejects.select("id", F.lit("rejected").alias("outcome")))


@query("redact_text", sql=f"SELECT doc_id, {duck.redact_text('text')} AS text FROM documents")
def _(spark, sf):
    return given(spark, sf, "documents").select("doc_id", privacy.redact_text(F.col("text")).alias("text"))


@query("redact_url", needs=("url_texts",), ctes=duck.redact_url("url_texts", "r"),
       sql="SELECT id, variant, _redacted_url AS url FROM r")
def _(spark, sf):
    return bind(spark, sf, "url_texts").withColumn("url", privacy.redact_url(F.col("url")))


@query("drop_sensitive_params", needs=("url_texts",), ctes=duck.drop_params("url_texts", "r"),
       sql="SELECT id, variant, _kept_url AS url FROM r")
def _(spark, sf):
    return bind(spark, sf, "url_texts").withColumn("url", privacy.drop_sensitive_params(F.col("url")))


@query("apply_load_defaults", needs=("raw_events",), ctes=duck.LOADABLE, sql="SELECT * FROM loadable")
def _(spark, sf):
    return validation.clean_events(bind(spark, sf, "raw_events"), timeparts.timestamp_lit(AS_OF))[0]


_KEYED = "event_key, type, app_name, window_title, url, title, timestamp, duration_seconds, event_date, id, user_id, created_at"
_EVENT_ROWS = (f"event_rows AS (SELECT {duck.usage_key()} AS event_key, type, app_name, window_title, url, title, timestamp,"
               " duration_seconds, CAST(timestamp AS DATE) AS event_date, id, user_id, TIMESTAMP '2024-01-31 00:00:00' AS created_at FROM usage_events)")


def loaded_table(spark, sf) -> str:
    path = scratch_dir(spark, "events")
    tables.load_events(bind(spark, sf, "usage_events"), path, timeparts.timestamp_lit(AS_OF))
    return path


@query("load_events", needs=("usage_events",), ctes=_EVENT_ROWS, sql=f"SELECT {_KEYED} FROM event_rows")
def _(spark, sf):
    return tables.read_usage_events(spark, loaded_table(spark, sf))


_TWO_USERS = """two_users AS (SELECT id, user_id, * EXCLUDE (id, user_id) FROM usage_events
  UNION ALL SELECT id + 1000000000, user_id + 1000000000, * EXCLUDE (id, user_id) FROM usage_events)"""


@query("upsert_events_users", needs=("usage_events",), ctes=_TWO_USERS, sql=f"""
SELECT {duck.usage_key()} AS event_key, type, app_name, window_title, url, title, timestamp, duration_seconds, id, user_id,
  CAST(timestamp AS DATE) AS event_date FROM two_users""")
def _(spark, sf):
    """Every event is there for two users, with all columns; loading them again changes nothing."""
    path, at = scratch_dir(spark, "events"), timeparts.timestamp_lit(AS_OF)
    events = bind(spark, sf, "usage_events")
    both = events.unionByName(events.withColumns({c: F.col(c) + 1_000_000_000 for c in ("id", "user_id")}))
    tables.upsert_events(events, path, at)
    for _ in range(2):
        tables.upsert_events(both, path, at)
    return tables.read_usage_events(spark, path).drop("created_at")


@query("read_usage_events", needs=("usage_events",), ctes=_EVENT_ROWS,
       sql=f"SELECT {_KEYED} FROM event_rows WHERE type = 'web' AND timestamp >= TIMESTAMP '2024-01-20 12:00:00'")
def _(spark, sf):
    return tables.read_usage_events(
        spark, loaded_table(spark, sf), "web", "2024-01-20 12:00:00")


@query("write_rejects", needs=("raw_events",), ctes=duck.VALIDATED,
       sql=f"SELECT {RAW_OUT}, reasons, 'raw' AS source, TIMESTAMP '2024-01-31 00:00:00' AS rejected_at FROM validated WHERE reasons <> ''")
def _(spark, sf):
    path = scratch_dir(spark, "rejects")
    _, rejects = validation.clean_events(bind(spark, sf, "raw_events"), timeparts.timestamp_lit(AS_OF))
    tables.write_rejects(rejects, path, "raw", timeparts.timestamp_lit(AS_OF))
    raw = F.from_json("raw", ", ".join(f"{c} {'LONG' if c == 'id' else 'STRING'}" for c in RAW_OUT.split(", ")))
    return spark.read.parquet(path).select(raw.alias("raw"), "reasons", "source", "rejected_at").select(
        "raw.*", F.concat_ws(",", "reasons").alias("reasons"), "source", "rejected_at")


@query("check_table_schema", sql="""
SELECT 'host' AS column_name, 'column missing' AS problem UNION ALL SELECT 'created_at', 'unexpected column'
UNION ALL SELECT 'duration_seconds', 'type int, expected bigint'""")
def _(spark, sf):
    expected = EVENTS_DDL.replace("created_at TIMESTAMP_NTZ", "host STRING").replace("_seconds INT", "_seconds BIGINT")
    return tables.check_table_schema(spark, spark.read.parquet(loaded_table(spark, sf)), expected)


@query("parse_event_ts", needs=("base_events",), sql="""
SELECT id, CASE id % 8
  WHEN 0 THEN CAST(CAST(timestamp AS DATE) AS TIMESTAMP) WHEN 1 THEN timestamp WHEN 2 THEN timestamp
  WHEN 3 THEN timestamp - INTERVAL '330' MINUTE WHEN 4 THEN date_trunc('second', timestamp)
  WHEN 5 THEN date_trunc('minute', timestamp) WHEN 6 THEN timestamp + INTERVAL '8' HOUR END AS parsed FROM base_events""")
def _(spark, sf):
    e = bind(spark, sf, "base_events")
    us = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (F.when(F.col("id") % 8 == 0, F.date_format("timestamp", "yyyy-MM-dd"))
            .when(F.col("id") % 8 == 1, us).when(F.col("id") % 8 == 2, F.concat(us, F.lit("Z")))
            .when(F.col("id") % 8 == 3, F.concat(us, F.lit("+05:30")))
            .when(F.col("id") % 8 == 4, F.date_format("timestamp", "yyyyMMdd'T'HHmmss"))
            .when(F.col("id") % 8 == 5, F.date_format("timestamp", "yyyy-MM-dd HH:mm"))
            .when(F.col("id") % 8 == 6, F.concat(us, F.lit("-0800")))
            .otherwise(F.date_format("timestamp", "yyyy-MM")))
    return e.select("id", timeparts.parse_event_ts(text).alias("parsed"))


@query("chromium_ts", needs=("visits",), sql="""
SELECT id, make_timestamp(visit_time - 11644473600000000) AS visited_at FROM visits""")
def _(spark, sf):
    return bind(spark, sf, "visits").select("id", timeparts.chromium_ts(F.col("visit_time")).alias("visited_at"))


@query("firefox_ts", needs=("firefox_rows",),
       sql="SELECT id, make_timestamp(visit_time) AS visited_at FROM firefox_rows")
def _(spark, sf):
    return bind(spark, sf, "firefox_rows").select("id", timeparts.firefox_ts(F.col("visit_time")).alias("visited_at"))


@query("to_chromium_us", sql="SELECT event_id, epoch_us(ts) + 11644473600000000 AS chromium_us FROM events")
def _(spark, sf):
    return given(spark, sf, "events").select("event_id", timeparts.to_chromium_us(F.col("ts")).alias("chromium_us"))


_SIGNED = "CASE p_partkey % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' ELSE '' END"


@query("csv_safe", sql=f"""
SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN '' WHEN p_partkey % 5 = 4 THEN p_name ELSE concat('''', {_SIGNED}, p_name) END AS field
FROM part""")
def _(spark, sf):
    text = F.expr(f"CASE WHEN p_partkey % 6 <> 0 THEN concat({_SIGNED}, p_name) END")
    return given(spark, sf, "part").select("p_partkey", privacy.csv_safe(text).alias("field"))


@query("event_date", sql="SELECT event_id, CAST(ts AS DATE) AS date FROM events")
def _(spark, sf):
    return given(spark, sf, "events").select("event_id", timeparts.event_date(F.col("ts")).alias("date"))


@query("extract_domain", needs=("url_texts",), sql=f"SELECT id, variant, {duck.domain('url')} AS domain FROM url_texts")
def _(spark, sf):
    return bind(spark, sf, "url_texts").select("id", "variant", web.extract_domain(F.col("url")).alias("domain"))


@query("is_web_url", needs=("url_texts",),
       sql="SELECT id, variant, url LIKE 'http://%' OR url LIKE 'https://%' AS is_web FROM url_texts")
def _(spark, sf):
    return bind(spark, sf, "url_texts").select("id", "variant", web.is_web_url(F.col("url")).alias("is_web"))


@query("extract_search_query", sql="SELECT p_partkey AS id, CASE WHEN p_partkey % 5 < 4 THEN p_name END AS search_query FROM part")
def _(spark, sf):
    return bind(spark, sf, "search_urls").select("id", web.extract_search_query(F.col("url")).alias("search_query"))


@query("normalize_title", sql=r"""
SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS title FROM documents""")
def _(spark, sf):
    return given(spark, sf, "documents").select("doc_id", web.normalize_title(F.col("text")).alias("title"))


@query("strip_browser_suffix", needs=("usage_events",), sql="""
SELECT id, coalesce(title, window_title) || CASE WHEN user_id % 3 = 2 THEN ' - Notepad' ELSE '' END AS title FROM usage_events""")
def _(spark, sf):
    return bind(spark, sf, "titles").select(
        "id", web.strip_browser_suffix(F.col("browser"), F.col("title")).alias("title"))


@query("redact_pii", sql=r"""
SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}', '[REDACTED]', 'g'),
  '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', '[REDACTED]', 'g') AS text FROM documents""")
def _(spark, sf):
    return given(spark, sf, "documents").select("doc_id", privacy.redact_pii(F.col("text")).alias("text"))


@query("mask_credentials", sql=r"""
SELECT doc_id, regexp_replace(regexp_replace(text,
  '(password|passwd|pwd|token|api[_-]?key|secret)([ \t]*[:=][ \t]*)[^ \t\r\n]+', '\1\2[REDACTED]', 'gi'),
  '(bearer)[ \t]+[^ \t\r\n]+', '\1 [REDACTED]', 'gi') AS text FROM documents""")
def _(spark, sf):
    return given(spark, sf, "documents").select("doc_id", privacy.mask_credentials(F.col("text")).alias("text"))


@query("shift_id", sql="SELECT event_id, CAST(hour(ts) // 8 + 1 AS INT) AS shift_id FROM events")
def _(spark, sf):
    return given(spark, sf, "events").select("event_id", timeparts.shift_id(F.col("ts")).alias("shift_id"))


@query("shift_bounds", sql="""
SELECT event_id, date_trunc('day', ts) + INTERVAL 8 HOUR * (hour(ts) // 8) AS starts_at,
  date_trunc('day', ts) + INTERVAL 8 HOUR * (hour(ts) // 8 + 1) AS ends_at FROM events""")
def _(spark, sf):
    day, shift = timeparts.event_date(F.col("ts")), timeparts.shift_id(F.col("ts"))
    return given(spark, sf, "events").select(
        "event_id", timeparts.shift_start(day, shift).alias("starts_at"), timeparts.shift_end(day, shift).alias("ends_at"))


@query("shift_order", sql="""
SELECT event_id, CAST((CAST(ts AS DATE) - DATE '1970-01-01') * 3 + hour(ts) // 8 AS INT) AS shift_order,
  CAST(ts AS DATE) AS date, CAST(hour(ts) // 8 + 1 AS INT) AS shift_id FROM events""")
def _(spark, sf):
    order = timeparts.shift_order(timeparts.event_date(F.col("ts")), timeparts.shift_id(F.col("ts")))
    day, shift = timeparts.shift_from_order(F.col("shift_order"))
    return given(spark, sf, "events").select("event_id", order.alias("shift_order")).select(
        "*", day.alias("date"), shift.alias("shift_id"))


@query("readable_duration", sql=f"""
SELECT l_orderkey, l_linenumber, {duck.READABLE} AS readable FROM
  (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS duration_seconds FROM lineitem)""")
def _(spark, sf):
    return given(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", timeparts.readable_duration(F.floor("l_extendedprice")).alias("readable"))


@query("position_seconds", needs=("media_polls",), sql="SELECT id, position_ticks / 1e7 AS seconds FROM media_polls")
def _(spark, sf):
    return bind(spark, sf, "media_polls").select(
        "id", timeparts.position_seconds(F.col("position_ticks")).alias("seconds"))
