"""Structured Streaming: ingest events, sessions and running counts with watermarks."""

from kairoflow.streaming.events import append_to_store, event_counts, read_events, sessions

__all__ = ["append_to_store", "event_counts", "read_events", "sessions"]
