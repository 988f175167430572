"""Structured Streaming: the late rule, ingest, windowed aggregates."""
