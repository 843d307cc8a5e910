"""Continuous ingest and live counters on Structured Streaming."""
