"""Incremental profile over Structured Streaming."""
