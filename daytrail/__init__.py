"""Activity-event analytics on Spark: ingest, clean, sessionise, join, report, export, retain."""
