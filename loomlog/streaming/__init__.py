"""Structured Streaming forms of the event jobs."""
