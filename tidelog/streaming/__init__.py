"""Structured Streaming variants of reads and statistics."""
