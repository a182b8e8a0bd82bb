"""The same work on streams of pages."""

from .ingest import extract_stream, first_seen_pages, polite_schedule, repeated_texts, session_counts, windowed_counts

__all__ = ["extract_stream", "first_seen_pages", "polite_schedule", "repeated_texts", "session_counts", "windowed_counts"]
