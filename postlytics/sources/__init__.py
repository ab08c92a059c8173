"""Sources and sinks: the events-derived posts table, messy CSV exports, writers."""

from postlytics.sources.fixtures import posts_from_events, read_table, POSTS_SQL

__all__ = ["posts_from_events", "read_table", "POSTS_SQL"]
