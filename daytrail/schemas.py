"""Column layouts of the tables."""

from __future__ import annotations

# Every field is read as text, so that a value of the wrong kind becomes a reject reason
# instead of a parse failure.
RAW_FIELDS = [
    "type", "app_name", "window_title", "process_id", "url", "title",
    "timestamp", "visit_time", "duration_seconds", "visit_duration", "id", "user_id",
]
RAW_DDL = ", ".join(f"{name} STRING" for name in RAW_FIELDS)

EVENTS_DDL = (
    "event_key STRING, type STRING, app_name STRING, window_title STRING, url STRING, "
    "title STRING, timestamp TIMESTAMP_NTZ, duration_seconds INT, created_at TIMESTAMP_NTZ, "
    "id LONG, user_id LONG, event_date DATE"
)
EVENT_COLUMNS = ["type", "app_name", "window_title", "url", "title", "timestamp", "duration_seconds"]
# Columns that frames may lack, as lines of a single user's feed do.
OWNER_COLUMNS = {"id": "long", "user_id": "long"}
# What tells rows of the table apart: `event_key` covers an event's fields, and two users may have equal ones.
EVENT_IDENTITY = ["event_date", "user_id", "event_key"]

# The fact tables' file columns.
FACT_COLUMNS = {
    "app_usage": ["logged_at", "started_at", "ended_at", "duration_seconds", "process_name",
                  "app_name", "window_title"],
    "website_visits": ["logged_at", "visited_at", "browser", "domain", "url", "page_title", "source"],
    "website_usage": ["logged_at", "started_at", "ended_at", "duration_seconds", "browser",
                      "domain", "url", "page_title", "source"],
    "media_playback": ["logged_at", "started_at", "ended_at", "duration_seconds", "source_app",
                       "title", "artist", "playback_state"],
    "media_track_change": ["logged_at", "changed_at", "source_app", "title", "artist",
                           "playback_state"],
}

# The unified log row.
UNIFIED_COLUMNS = ["timestamp", "category", "source", "item", "event_type", "duration_seconds",
                   "window", "url"]

# The daily and shift CSV header.
DAILY_CSV_COLUMNS = ["timestamp", "category", "item", "duration_seconds", "duration_readable",
                     "source", "event_type", "window", "url"]
