"""Non-versioned pairs and key-range metadata on small fixtures."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from keystrata.functions.checksum import crc64_batch
from keystrata.operators import raw as R
from keystrata.operators import regions as G
from keystrata.sources.tables import read_version, write_version

TABLE = "key string, value string, expire_ts bigint"
NOW = 1000


def _table(spark, *rows):
    return spark.createDataFrame([(k, v, e) for k, v, e in rows], TABLE)


def _letters(spark, letters="abcde"):
    return _table(spark, *[(k, k.upper(), None) for k in letters])


def _keys(df):
    return [r.key for r in df.collect()]


def test_scan(spark):
    t = _letters(spark)
    assert _keys(R.scan(t, NOW, "b", "d")) == ["b", "c"]
    assert _keys(R.scan(t, NOW, limit=3)) == ["a", "b", "c"]
    assert _keys(R.scan(t, NOW, reverse=True)) == ["e", "d", "c", "b", "a"]
    assert R.scan(t, NOW, key_only=True).columns == ["key"]


def test_expiry(spark):
    t = _table(spark, ("a", "1", NOW + 3600), ("b", "2", NOW - 10), ("c", "3", None), ("d", "4", NOW))
    assert _keys(R.scan(t, NOW)) == ["a", "c"]
    assert {r.key: r.ttl for r in R.key_ttl(t, NOW).collect()} == {"a": 3600, "c": 0}
    assert R.get(t, "b", NOW).count() == 0 and R.get(t, "a", NOW).count() == 1


def test_batch_scan(spark):
    t = _letters(spark, "abcdef")
    assert sorted(_keys(R.batch_scan(t, [("a", "c"), ("d", "f")], 10, NOW))) == ["a", "b", "d", "e"]
    assert sorted(_keys(R.batch_scan(t, [("a", "d"), ("d", "g")], 2, NOW))) == ["a", "b", "d", "e"]
    many = R.batch_scan(t, [("a", "d"), (None, None), ("e", "b"), ("x", None), ("c", None)] * 400, 2, NOW)
    got = {}
    for r in many.collect():
        got.setdefault(r.range_id, []).append(r.key)
    assert {i % 5: sorted(x) for i, x in got.items()} == {0: ["a", "b"], 1: ["a", "b"], 4: ["c", "d"]} and len(got) == 1200


@pytest.mark.parametrize("few", [True, False])
def test_batch_scan_against_brute_force(spark, monkeypatch, few):
    """Ranges that overlap, are empty, reversed, open or start at a key, over blocks of a few rows."""
    monkeypatch.setattr(G, "BLOCK_ROWS", 7)
    monkeypatch.setattr(R, "BROADCAST_BYTES", 1 << 20 if few else 0)
    keys = [f"{k:04d}" for k in range(0, 600, 3)] + ["é", "z", "🙂"]
    bounds = [None, "", "0000", "0003", "0004", "0299", "0300", "0597", "0598", "y", "é", "🙂", "~"]
    ranges = [(a, b) for a in bounds for b in bounds] * 2
    t = _table(spark, *[(k, k * 2, None if i % 4 else NOW - 1 + i % 8) for i, k in enumerate(keys)], (None, "x", None))
    alive = sorted((k for i, k in enumerate(keys) if i % 4 or i % 8 > 1), key=str.encode)
    for limit in (1, 5, 1000):
        want = sorted((i, k, k * 2) for i, (a, b) in enumerate(ranges) for k in [k for k in alive if k.encode() >= (a or "").encode() and (b is None or k.encode() < b.encode())][:limit])
        assert sorted(map(tuple, R.batch_scan(t, ranges, limit, NOW).collect())) == want


def test_ranges_meet_no_more_rows_than_they_return(spark):
    """A thousand ranges over all keys meet the keys of their positions, not all keys of the segments that they cover."""
    t = spark.range(20_000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("key"), F.lit("v").alias("value"), F.lit(None).cast("bigint").alias("expire_ts"))
    out = R.batch_scan(t, spark.range(1000).select(F.col("id").alias("range_id"), F.lit("000001").alias("start"), F.lit(None).cast("string").alias("end")), 3, NOW)
    assert out.count() == 3000 and {r.key for r in out.select("key").distinct().collect()} == {"000001", "000002", "000003"}
    assert not re.search(r"Join [^\n]*region_id", out._jdf.queryExecution().optimizedPlan().toString())


def test_change_sets(spark):
    puts = R.put_changes(spark.createDataFrame([("a", "x", 0, 1), ("a", "y", 5, 2)], "key string, value string, ttl bigint, seq bigint"), NOW)
    gone = R.delete_changes(spark.createDataFrame([("b",), ("b",)], "key string"))
    changes = puts.unionByName(gone)
    assert sorted(map(tuple, changes.collect())) == [("delete", "b", None, None), ("put", "a", "y", NOW + 5)]
    after = R.apply_changes(_letters(spark, "abc"), changes)
    assert sorted(map(tuple, after.collect()), key=str) == [("a", "y", NOW + 5), ("c", "C", None)]


def test_families(spark):
    families = {"default": _letters(spark, "ab"), "other": _letters(spark, "xyz")}
    assert R.in_family(families).count() == 2 and R.in_family(families, "other").count() == 3
    with pytest.raises(ValueError):
        R.in_family(families, "none")


def test_writes(spark):
    batch = spark.createDataFrame([("a", "old", 0, 1), ("a", "new", 7200, 2), ("z", "1", None, 3)], "key string, value string, ttl bigint, seq bigint")
    after = {r.key: (r.value, r.expire_ts) for r in R.batch_put(_letters(spark, "ab"), batch, NOW).collect()}
    assert after == {"a": ("new", NOW + 7200), "b": ("B", None), "z": ("1", None)}
    gone = spark.createDataFrame([("a",), ("x",)], "key string")
    assert sorted(_keys(R.batch_delete(_letters(spark, "ab"), gone))) == ["b"]
    assert sorted(_keys(R.delete_range(_letters(spark), "b", "d"))) == ["a", "d", "e"]
    assert sorted(_keys(R.batch_get(_letters(spark), spark.createDataFrame([("a",), ("a",), ("x",)], "key string"), NOW))) == ["a", "a"]


def test_compare_and_swap(spark):
    t = _table(spark, ("k", "v1", None), ("late", "v1", NOW - 1))
    ask = spark.createDataFrame([("k", "v1", "v2"), ("absent", None, "x"), ("late", None, "x")], "key string, expected string, value string")
    assert {r.key: (r.success, r.previous) for r in R.compare_and_swap(t, ask, NOW).collect()} == {"k": (True, "v1"), "absent": (True, None), "late": (True, None)}
    wrong = spark.createDataFrame([("k", "wrong", "v2")], "key string, expected string, value string")
    assert (lambda r: (r.success, r.previous))(R.compare_and_swap(t, wrong, NOW).first()) == (False, "v1")


def test_checksum(spark):
    t = _table(spark, ("a", "1", None), ("b", "2", None), ("c", "3", None), ("d", "4", NOW - 1))
    row = R.checksum(t, NOW, "a", "d").first()
    want = 0
    for x in crc64_batch([b"a1", b"b2", b"c3"]):
        want ^= int(x)
    assert tuple(row) == (want, 3, 6)
    assert tuple(R.checksum(t, NOW, "x", "y").first()) == (0, 0, 0)


def test_versions_of_a_table(spark, tmp_path):
    write_version(_letters(spark), str(tmp_path), 1, "key")
    write_version(R.delete_range(read_version(spark, str(tmp_path), 1), "b", "d"), str(tmp_path), 2, "key")
    assert read_version(spark, str(tmp_path), 1).count() == 5 and read_version(spark, str(tmp_path), 2).count() == 3


def test_regions(spark, monkeypatch):
    regions = G.regions_from(spark.createDataFrame([("c",), ("e",), ("c",)], "key string"))
    keys = spark.createDataFrame([(k,) for k in "abcdef"], "key string")
    want = {"a": 1, "b": 1, "c": 2, "d": 2, "e": 3, "f": 3}
    assert {r.key: r.region_id for r in G.lookup(keys, regions).collect()} == want
    monkeypatch.setattr(G, "BROADCAST_BYTES", 20)
    assert {r.key: r.region_id for r in G.lookup(keys, regions).collect()} == want
    cut = G.split(regions.withColumn("version", F.lit(1)), spark.createDataFrame([(1, "b"), (3, "a")], "region_id int, key string"))
    assert sorted((r.start_key, r.end_key or "~", r.version) for r in cut.collect()) == [("", "b", 2), ("b", "c", 2), ("c", "e", 1), ("e", "~", 1)]
    pair = spark.createDataFrame([(1, 2), (1, 3)], "left_id int, right_id int")
    assert [(r.start_key, r.end_key, r.version) for r in G.merge(regions.withColumn("version", F.lit(1)), pair).collect()] == [("", "e", 2)]


def test_store_states(spark):
    stores = spark.createDataFrame([(1, NOW - 30, False), (2, NOW - 31, False), (3, NOW - 1801, False), (4, NOW, True)], "store_id int, last_heartbeat bigint, tombstone boolean")
    assert {r.store_id: r.state for r in G.store_states(stores, NOW).collect()} == {1: "up", 2: "disconnected", 3: "down", 4: "tombstone"}
