"""Chunked delivery of results."""
