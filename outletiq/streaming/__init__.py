"""Structured Streaming wrappers for incremental loading."""
