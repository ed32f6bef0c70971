"""Structured Streaming: ingest, alarms, feed."""
