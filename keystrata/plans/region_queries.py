"""Key-range metadata over orders and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystrata.operators import regions as G
from keystrata.sources.tables import byte_key, pending, ended, raw_orders, read

NOW = 4000
#: Regions begin at each customer's first order key, rounded down to thousands.
B_SQL = """t AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS key, o_orderstatus || '|' || o_orderpriority AS value FROM orders),
b AS (SELECT DISTINCT lpad((o_orderkey // 1000 * 1000)::VARCHAR, 12, '0') AS start_key FROM orders UNION SELECT ''),
r AS (SELECT row_number() OVER (ORDER BY start_key) AS region_id, start_key, lead(start_key) OVER (ORDER BY start_key) AS end_key FROM b),
located AS (SELECT key, value, region_id FROM t JOIN r ON key >= start_key AND (end_key IS NULL OR key < end_key))"""
P_SQL = "p AS (SELECT s_suppkey AS region_id, [s_suppkey % 7, s_nationkey % 7 + 7, s_suppkey % 5 + 14] AS peers, s_nationkey % 7 + 7 AS leader FROM supplier)"


def _regions(spark, sf_dir):
    starts = read(spark, sf_dir, "orders").select(byte_key(F.floor(F.col("o_orderkey") / 1000) * 1000).alias("key"))
    return G.regions_from(starts)


def _located(spark, sf_dir):
    rows = raw_orders(read(spark, sf_dir, "orders")).select("key", "value")
    return G.lookup(rows, _regions(spark, sf_dir))


def _lookup(spark, sf_dir):
    return _located(spark, sf_dir).select("key", F.col("region_id").cast("bigint").alias("region_id"))


def _size(spark, sf_dir):
    return G.sizes(_located(spark, sf_dir)).select(F.col("region_id").cast("bigint").alias("region_id"), "n_bytes", "n_keys")


def _split_key(spark, sf_dir):
    return G.split_keys(_located(spark, sf_dir), 16000).select(F.col("region_id").cast("bigint").alias("region_id"), "n_bytes", "split_key")


def _versioned(spark, sf_dir):
    return _regions(spark, sf_dir).withColumn("version", F.lit(1).cast("bigint"))


def _split(spark, sf_dir):
    regions = _versioned(spark, sf_dir)
    cuts = G.split_keys(_located(spark, sf_dir), 16000).select("region_id", F.col("split_key").alias("key"))
    return G.split(regions, cuts).select("start_key", "end_key", "version")


def _merge(spark, sf_dir):
    regions = _versioned(spark, sf_dir)
    pairs = regions.filter("region_id % 2 = 1").select(F.col("region_id").alias("left_id"), (F.col("region_id") + 1).alias("right_id"))
    return G.merge(regions, pairs).select(F.col("region_id").cast("bigint").alias("region_id"), "start_key", "end_key", "version")


def _placed(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    near = (F.col("s_nationkey") % 7 + 7).cast("bigint")
    return s.select(F.col("s_suppkey").alias("region_id"), F.array(F.col("s_suppkey") % 7, near, F.col("s_suppkey") % 5 + 14).alias("peers"), near.alias("leader"))


def _per_store(spark, sf_dir):
    return G.count_per_store(_placed(spark, sf_dir))


def _imbalance(spark, sf_dir):
    return G.imbalance(G.count_per_store(_placed(spark, sf_dir)), "n_regions", 0.05)


def _states(spark, sf_dir):
    stores = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("store_id"), (F.lit(NOW) - F.col("s_suppkey") % 60 * F.col("s_suppkey") % 3001).alias("last_heartbeat"), (F.col("s_nationkey") == 3).alias("tombstone")
    )
    return G.store_states(stores, NOW)


def _export(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    tables = [("write", ended(events).select(F.col("user_key").alias("key"), F.col("write_type").alias("value"))), ("lock", pending(events).select(F.col("user_key").alias("key"), F.col("lock_type").alias("value")))]
    return G.range_checksum(tables)


_SUMMED = "u AS (SELECT *, sum(strlen(key) + strlen(value)) OVER (PARTITION BY region_id ORDER BY key) AS upto FROM located), k AS (SELECT region_id, max(upto)::BIGINT AS n_bytes, min(CASE WHEN upto * 2 >= 16000 THEN key END) AS split_key FROM u GROUP BY region_id HAVING max(upto) > 16000)"
_STORES = f"WITH {P_SQL}, e AS (SELECT leader, unnest(peers) AS store_id FROM p), c AS (SELECT store_id, count(*) AS n_regions, count(*) FILTER (leader = store_id) AS n_leaders FROM e GROUP BY store_id)"

QUERIES = {
    "region_lookup": (_lookup, f"WITH {B_SQL} SELECT key, region_id FROM located"),
    "region_size": (_size, f"WITH {B_SQL} SELECT region_id, sum(strlen(key) + strlen(value))::BIGINT AS n_bytes, count(*) AS n_keys FROM located GROUP BY region_id"),
    "region_split_key": (_split_key, f"WITH {B_SQL}, {_SUMMED} SELECT region_id, n_bytes, split_key FROM k"),
    "region_split": (
        _split,
        f"""WITH {B_SQL}, {_SUMMED}, c AS (SELECT r.region_id, split_key FROM k JOIN r USING (region_id) WHERE split_key > start_key),
        s AS (SELECT start_key, r.region_id, end_key FROM r UNION ALL SELECT split_key, region_id, end_key FROM c JOIN r USING (region_id))
        SELECT start_key, coalesce(lead(start_key) OVER (PARTITION BY region_id ORDER BY start_key), end_key) AS end_key, count(*) OVER (PARTITION BY region_id) AS version FROM s""",
    ),
    "region_merge": (_merge, f"WITH {B_SQL} SELECT a.region_id, a.start_key, b.end_key, 2::BIGINT AS version FROM r a JOIN r b ON b.region_id = a.region_id + 1 WHERE a.region_id % 2 = 1"),
    "region_count_per_store": (_per_store, f"{_STORES} SELECT * FROM c"),
    "region_imbalance": (_imbalance, f"{_STORES} SELECT * FROM c WHERE n_regions > 1.05 * (SELECT avg(n_regions) FROM c)"),
    "store_state": (
        _states,
        """WITH s AS (SELECT s_suppkey AS store_id, 4000 - s_suppkey % 60 * s_suppkey % 3001 AS last_heartbeat, s_nationkey = 3 AS tombstone FROM supplier)
        SELECT *, CASE WHEN tombstone THEN 'tombstone' WHEN 4000 - last_heartbeat > 1800 THEN 'down' WHEN 4000 - last_heartbeat > 30 THEN 'disconnected' ELSE 'up' END AS state FROM s""",
    ),
    "region_export": (_export, None),
}
