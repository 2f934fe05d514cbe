"""Structured Streaming forms of the progress log and of last-value state."""
