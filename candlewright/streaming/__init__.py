"""Structured Streaming forms of the operational jobs."""
