"""Operators on streams of events."""

from obsq.streaming.buckets import bucket_stream, read_event_stream

__all__ = ["bucket_stream", "read_event_stream"]
