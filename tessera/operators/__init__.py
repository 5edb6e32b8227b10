"""Relational operators of the profiler and of the retrieval pipeline."""
