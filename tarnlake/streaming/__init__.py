"""Structured Streaming forms of ingest, dedup, expiry and consolidation."""
