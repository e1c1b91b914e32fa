"""Streaming ingestion, batching and the live tail."""
