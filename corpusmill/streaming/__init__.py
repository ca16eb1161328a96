"""Structured Streaming: events, windows and stateful limits."""
