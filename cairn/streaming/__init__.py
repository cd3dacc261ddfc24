"""Structured Streaming forms of the watch loop and the work queue."""
