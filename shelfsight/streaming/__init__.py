"""Structured Streaming forms of landing, tailing, throttling and stage state."""
