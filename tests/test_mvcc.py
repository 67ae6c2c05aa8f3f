"""Multi-version reads and garbage collection on small fixtures."""

from __future__ import annotations

import random

import pytest

from keystrata.operators import garbage as G
from keystrata.operators import mvcc as M

WRITES = "user_key string, commit_ts bigint, start_ts bigint, write_type string, short_value string"
LOCKS = "user_key string, lock_type string, primary_key string, start_ts bigint, ttl bigint, for_update_ts bigint, min_commit_ts bigint"


def _writes(spark, rows):
    return spark.createDataFrame([(k, ts, ts - 1, kind, value) for k, ts, kind, value in rows], WRITES)


def _locks(spark, *rows):
    return spark.createDataFrame([(k, kind, k, ts, 3000, ts, ts + 1) for k, kind, ts in rows], LOCKS)


def _pairs(df):
    return [(r.user_key, r.short_value) for r in df.collect()]


def test_versions(spark):
    w = _writes(spark, [("k", ts, "P", f"v{ts}") for ts in (3, 5, 7, 9, 11)])
    assert _pairs(M.snapshot(w, 8)) == [("k", "v7")]
    assert _pairs(M.snapshot(w)) == [("k", "v11")]
    assert M.snapshot(w, 2).count() == 0


def test_deletes_locks_and_rollbacks_are_looked_through(spark):
    w = _writes(spark, [("a", 5, "P", "va"), ("b", 5, "P", "vb"), ("b", 8, "D", None), ("c", 5, "P", "vc"), ("c", 7, "R", None), ("c", 8, "L", None)])
    assert _pairs(M.scan(w, read_ts=10)) == [("a", "va"), ("c", "vc")]
    assert _pairs(M.scan(w, read_ts=7, descending=True)) == [("c", "vc"), ("b", "vb"), ("a", "va")]
    assert {(r.user_key, r.write_type) for r in M.seek_write(w, 10).collect()} == {("a", "P"), ("b", "D"), ("c", "L")}


def test_newer_neighbour_is_no_hindrance(spark):
    w = _writes(spark, [("A", 10, "P", "new"), ("B", 3, "P", "vb")])
    assert _pairs(M.scan(w, read_ts=5)) == [("B", "vb")]


def test_bounds_keys_and_empty(spark):
    w = _writes(spark, [(k, 5, "P", k) for k in "abcde"])
    assert [r.user_key for r in M.scan(w, "b", "d", 10, key_only=True).collect()] == ["b", "c"]
    assert M.scan(_writes(spark, []), read_ts=10).count() == 0
    assert _pairs(M.point_get(w, "c", 10)) == [("c", "c")] and M.point_get(w, "z", 10).count() == 0
    keys = spark.createDataFrame([("a",), ("a",), ("z",)], "user_key string")
    assert _pairs(M.batch_get(w, keys, 10)) == [("a", "a"), ("a", "a")]


def test_locks(spark):
    w = _writes(spark, [("a", 5, "P", "va")])
    blocked = lambda *lock, bypass=(): M.lock_conflicts(_locks(spark, lock), 10, bypass).count()
    assert blocked("a", "P", 8) == 1
    assert blocked("a", "P", 15) == 0
    assert blocked("a", "S", 8) == 0
    assert blocked("a", "P", 8, bypass=(8,)) == 0
    row = M.read_with_locks(w, _locks(spark, ("a", "P", 8)), 10).first()
    assert (row.status, row.short_value) == ("locked", None)


def test_long_values(spark):
    w = _writes(spark, [("short", 5, "P", "sv"), ("long", 5, "P", None)])
    values = spark.createDataFrame([("long", 4, "long-value-data")], "user_key string, start_ts bigint, value string")
    assert {(r.user_key, r.value) for r in M.with_value(M.snapshot(w, 9), values).collect()} == {("short", "sv"), ("long", "long-value-data")}


@pytest.mark.parametrize(
    "rows, safe, kept",
    [
        ([(10, "P"), (20, "P"), (30, "P")], 15, [10, 20, 30]),
        ([(10, "P"), (20, "P"), (30, "P")], 25, [20, 30]),
        ([(10, "P"), (20, "L"), (25, "R"), (30, "P")], 28, [10, 30]),
        ([(10, "P"), (20, "D"), (30, "P")], 25, [30]),
        ([], 25, []),
    ],
)
def test_gc(spark, rows, safe, kept):
    w = _writes(spark, [("k", ts, kind, "v") for ts, kind in rows])
    assert sorted(r.commit_ts for r in G.survivors(w, safe).collect()) == kept
    assert G.deleted(w, safe).count() == len(rows) - len(kept)


def test_gc_drops_long_values(spark):
    w = _writes(spark, [("k", 10, "P", None), ("k", 20, "P", "v")])
    values = spark.createDataFrame([("k", 9, "x" * 300), ("k", 99, "y")], "user_key string, start_ts bigint, value string")
    assert [r.start_ts for r in G.orphan_values(w, values, 25).collect()] == [9]


def test_gc_leaves_later_reads_alone(spark):
    dice = random.Random(5)
    w = _writes(spark, [(dice.choice("abcdef"), ts, dice.choice("PPDLR"), str(ts)) for ts in range(1, 120)])
    kept = G.survivors(w, 60)
    for ts in (60, 61, 75, 119):
        assert sorted(_pairs(M.snapshot(w, ts))) == sorted(_pairs(M.snapshot(kept, ts)))
    assert G.safe_point(10, 5) == 10


def test_point_reads_agree_with_scans(spark):
    dice = random.Random(6)
    w = _writes(spark, [(dice.choice("abcd"), ts, dice.choice("PPD"), str(ts)) for ts in range(1, 60)])
    for ts in (5, 30, 59):
        assert sorted(_pairs(M.scan(w, read_ts=ts))) == sorted(p for k in "abcd" for p in _pairs(M.point_get(w, k, ts)))
