"""Non-versioned key-value operators over orders."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from keystrata.operators import raw as R
from keystrata.sources.tables import byte_key, raw_orders, read

NOW = 500
T = """t AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS key, o_orderstatus || '|' || o_orderpriority AS value, CASE WHEN o_orderstatus <> 'O' THEN o_custkey % 1000 END AS expire_ts FROM orders),
live AS (SELECT * FROM t WHERE expire_ts IS NULL OR expire_ts > 500)"""
LOW, HIGH = "000000000100", "000000009000"


def _t(spark, sf_dir):
    return raw_orders(read(spark, sf_dir, "orders"))


def _scan(reverse, key_only, limit, spark, sf_dir):
    return R.scan(_t(spark, sf_dir), NOW, LOW, HIGH, limit, key_only, reverse)


def _get(spark, sf_dir):
    return R.get(_t(spark, sf_dir), "000000000007", NOW)


def _keys(spark, sf_dir, name="part", column="p_partkey"):
    return read(spark, sf_dir, name).select(byte_key(column).alias("key"))


def _batch_get(spark, sf_dir):
    return R.batch_get(_t(spark, sf_dir), _keys(spark, sf_dir), NOW).select("key", "value")


def _batch_scan(spark, sf_dir):
    return R.batch_scan(_t(spark, sf_dir), [("000000000100", "000000000200"), ("000000000150", "000000000400"), ("000000001000", None)], 20, NOW)


def _put(spark, sf_dir):
    return R.batch_put(_t(spark, sf_dir), _batch(spark, sf_dir), NOW)


def _delete(spark, sf_dir):
    return R.batch_delete(_t(spark, sf_dir), _keys(spark, sf_dir)).select("key", "value")


def _delete_range(spark, sf_dir):
    return R.delete_range(_t(spark, sf_dir), LOW, HIGH).select("key", "value")


def _live(spark, sf_dir):
    return R.live(_t(spark, sf_dir), NOW)


def _ttl(spark, sf_dir):
    return R.key_ttl(_t(spark, sf_dir), NOW)


def _cas(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    requests = parts.select(byte_key("p_partkey").alias("key"), F.when(F.col("p_size") > 25, F.lit("O|1-URGENT")).alias("expected"), F.col("p_brand").alias("value"))
    return R.compare_and_swap(_t(spark, sf_dir), requests, NOW).select("key", "value", "previous", "success")


def _checksum(spark, sf_dir):
    return R.checksum(_t(spark, sf_dir), NOW, LOW, HIGH)


def _batch(spark, sf_dir):
    customers = read(spark, sf_dir, "customer")
    return customers.select(byte_key(F.col("c_custkey") % 1200).alias("key"), F.col("c_mktsegment").alias("value"), F.col("c_nationkey").cast("bigint").alias("ttl"), F.col("c_custkey").alias("seq"))


def _changes(spark, sf_dir):
    return R.put_changes(_batch(spark, sf_dir), NOW).unionByName(R.delete_changes(_keys(spark, sf_dir)))


def _family(spark, sf_dir):
    table = _t(spark, sf_dir)
    families = {"default": R.live(table, NOW), "archive": table.filter(F.col("value").startswith("F"))}
    parts = [R.in_family(families, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name or "default").alias("family"), "n") for name in (None, "archive")]
    return parts[0].unionByName(parts[1])


def _many_ranges(spark, sf_dir):
    """A range for each part: overlapping ones, whose number grows with the tables."""
    part, at = read(spark, sf_dir, "part"), F.col("p_partkey") * 7
    ranges = part.select(F.col("p_partkey").alias("range_id"), byte_key(at).alias("start"), byte_key(at + F.col("p_size") * 20).alias("end"))
    return R.batch_scan(_t(spark, sf_dir), ranges, 5, NOW)


_IN = f"key >= '{LOW}' AND key < '{HIGH}'"
_RANGES = (("'000000000100'", "'000000000200'"), ("'000000000150'", "'000000000400'"), ("'000000001000'", "'~'"))

QUERIES = {
    "raw_get": (_get, f"WITH {T} SELECT key, value, expire_ts FROM live WHERE key = '000000000007'"),
    "raw_scan": (partial(_scan, False, False, 0), f"WITH {T} SELECT key, value FROM live WHERE {_IN}"),
    "raw_scan_limit": (partial(_scan, False, False, 200), f"WITH {T} SELECT key, value FROM live WHERE {_IN} ORDER BY key LIMIT 200"),
    "raw_scan_reverse": (partial(_scan, True, False, 200), f"WITH {T} SELECT key, value FROM live WHERE {_IN} ORDER BY key DESC LIMIT 200"),
    "raw_scan_key_only": (partial(_scan, False, True, 0), f"WITH {T} SELECT key FROM live WHERE {_IN}"),
    "raw_batch_get": (_batch_get, f"WITH {T} SELECT key, value FROM live JOIN part ON key = lpad(p_partkey::VARCHAR, 12, '0')"),
    "raw_batch_scan": (
        _batch_scan,
        f"WITH {T} " + " UNION ALL ".join(f"SELECT * FROM (SELECT {i}::INTEGER AS range_id, key, value FROM live WHERE key >= {a} AND key < {b} ORDER BY key LIMIT 20)" for i, (a, b) in enumerate(_RANGES)),
    ),
    "raw_batch_put": (
        _put,
        f"""WITH {T}, b AS (SELECT lpad((c_custkey % 1200)::VARCHAR, 12, '0') AS key, arg_max(c_mktsegment, c_custkey) AS value, arg_max(c_nationkey, c_custkey) AS ttl FROM customer GROUP BY 1)
        SELECT key, value, expire_ts FROM t ANTI JOIN b USING (key) UNION ALL SELECT key, value, CASE WHEN ttl > 0 THEN 500 + ttl END FROM b""",
    ),
    "raw_batch_delete": (_delete, f"WITH {T} SELECT key, value FROM t WHERE key NOT IN (SELECT lpad(p_partkey::VARCHAR, 12, '0') FROM part)"),
    "raw_delete_range": (_delete_range, f"WITH {T} SELECT key, value FROM t WHERE NOT ({_IN})"),
    "raw_ttl_filter": (_live, f"WITH {T} SELECT key, value, expire_ts FROM live"),
    "raw_key_ttl": (_ttl, f"WITH {T} SELECT key, coalesce(expire_ts - 500, 0)::BIGINT AS ttl FROM live"),
    "raw_cas": (
        _cas,
        f"""WITH {T}, r AS (SELECT lpad(p_partkey::VARCHAR, 12, '0') AS key, CASE WHEN p_size > 25 THEN 'O|1-URGENT' END AS expected, p_brand AS value FROM part)
        SELECT r.key, r.value, live.value AS previous, live.value IS NOT DISTINCT FROM expected AS success FROM r LEFT JOIN live USING (key)""",
    ),
    "raw_checksum": (_checksum, None),
    "raw_changes": (
        _changes,
        """WITH p AS (SELECT lpad((c_custkey % 1200)::VARCHAR, 12, '0') AS key, arg_max(c_mktsegment, c_custkey) AS value, arg_max(c_nationkey, c_custkey) AS ttl FROM customer GROUP BY 1)
        SELECT 'put' AS op, key, value, CASE WHEN ttl > 0 THEN 500 + ttl END AS expire_ts FROM p UNION ALL SELECT DISTINCT 'delete', lpad(p_partkey::VARCHAR, 12, '0'), NULL, NULL FROM part""",
    ),
    "raw_family": (_family, f"WITH {T} SELECT 'default' AS family, count(*) AS n FROM live UNION ALL SELECT 'archive', count(*) FROM t WHERE value LIKE 'F%'"),
    "raw_many_ranges": (
        _many_ranges,
        f"""WITH {T}, r AS (SELECT p_partkey AS range_id, lpad((p_partkey * 7)::VARCHAR, 12, '0') AS a, lpad((p_partkey * 7 + p_size * 20)::VARCHAR, 12, '0') AS b FROM part)
        SELECT range_id, key, value FROM r JOIN live ON key >= a AND key < b QUALIFY row_number() OVER (PARTITION BY range_id ORDER BY key) <= 5""",
    ),
}
