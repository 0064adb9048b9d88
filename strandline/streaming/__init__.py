"""Structured Streaming forms of the time buckets, deduplication and weighted means."""
