"""Incremental indexing and streams."""
