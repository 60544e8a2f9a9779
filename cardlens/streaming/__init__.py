"""Incremental loading of new account batches with Structured Streaming."""
