"""Registered queries of the key-value operators, with their SQL."""

from __future__ import annotations

from keystrata.plans import codec_queries, mvcc_queries, pipeline_queries, raw_queries, region_queries, transaction_queries

_ALL = {}
for _part in (pipeline_queries, mvcc_queries, raw_queries, transaction_queries, region_queries, codec_queries):
    _ALL |= _part.QUERIES


def queries() -> dict:
    """Query functions (spark, sf_dir) by name."""
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    """SQL that gives the same rows; checksums, codes of keys and chunks have none and are tested by brute force."""
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
