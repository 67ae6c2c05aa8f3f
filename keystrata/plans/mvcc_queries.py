"""Multi-version reads and garbage collection over the event history."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from keystrata.operators import garbage as G
from keystrata.operators import mvcc as M
from keystrata.sources.tables import byte_key, ended, history, pending, read

READ_TS, SAFE_POINT = 10000, 9000
SMALL_VALUE = 50.0

H = """h AS (SELECT lpad(user_id::VARCHAR, 12, '0') AS user_key, event_id * 2 + 2 AS commit_ts, event_id * 2 + 1 AS start_ts,
  CASE event_type WHEN 'click' THEN 'D' WHEN 'view' THEN 'L' WHEN 'error' THEN 'R' ELSE 'P' END AS write_type, value AS short_value, props, event_id, user_id, event_type FROM events)"""
L = """newest AS (SELECT user_id, max(event_id) AS last_id FROM events GROUP BY user_id),
locks AS (SELECT lpad(e.user_id::VARCHAR, 12, '0') AS user_key, CASE event_type WHEN 'click' THEN 'D' WHEN 'view' THEN 'L' WHEN 'error' THEN 'S' ELSE 'P' END AS lock_type,
  lpad((e.user_id // 10 * 10)::VARCHAR, 12, '0') AS primary_key, event_id * 2 + 1 AS start_ts, 3000 + e.user_id AS ttl, event_id * 2 + 1 AS for_update_ts, event_id * 2 + 2 AS min_commit_ts, value AS short_value
  FROM events e JOIN newest n ON e.user_id = n.user_id AND event_id = last_id)"""
W = "writes AS (SELECT h.* FROM h JOIN newest USING (user_id) WHERE event_id < last_id)"


def visible(ts, source="h"):
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY commit_ts DESC) AS rk FROM {source} WHERE write_type IN ('P', 'D') AND commit_ts <= {ts}) WHERE rk = 1 AND write_type = 'P')"


def _h(spark, sf_dir):
    return history(read(spark, sf_dir, "events"))


def _locks(spark, sf_dir):
    return pending(read(spark, sf_dir, "events"))


def _snapshot(spark, sf_dir):
    return M.snapshot(_h(spark, sf_dir), READ_TS).select("user_key", "commit_ts", "short_value")


def _point(spark, sf_dir):
    return M.point_get(_h(spark, sf_dir), "000000000014", READ_TS).select("user_key", "commit_ts", "short_value")


def _batch(spark, sf_dir):
    keys = read(spark, sf_dir, "nation").select(byte_key("n_nationkey").alias("user_key"))
    keys = keys.unionAll(read(spark, sf_dir, "region").select(byte_key("r_regionkey").alias("user_key")))
    return M.batch_get(_h(spark, sf_dir), keys, READ_TS).select("user_key", "commit_ts", "short_value")


def _scan(descending, key_only, spark, sf_dir):
    rows = M.scan(_h(spark, sf_dir), "000000000010", "000000000090", READ_TS, descending, key_only)
    return rows if key_only else rows.select("user_key", "commit_ts", "short_value")


def _seek(spark, sf_dir):
    return M.seek_write(_h(spark, sf_dir), READ_TS).select("user_key", "commit_ts", "write_type")


def _record(spark, sf_dir):
    wanted = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("start_ts"))
    asked = _h(spark, sf_dir).select("user_key", "start_ts").join(wanted, "start_ts")
    return M.commit_record(_h(spark, sf_dir), asked).select("user_key", "start_ts", "commit_ts", "write_type")


def _conflicts(bypass, spark, sf_dir):
    locks = _locks(spark, sf_dir)
    skipped = locks.orderBy("start_ts").limit(5).select("start_ts") if bypass else ()
    return M.lock_conflicts(locks, 20000, skipped).select("user_key", "start_ts", "lock_type")


def _committed(spark, sf_dir):
    return M.snapshot(ended(read(spark, sf_dir, "events")), None).select("user_key", "commit_ts", "short_value")


def _with_locks(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return M.read_with_locks(ended(events), pending(events), 20000).select("user_key", "status", "short_value", "lock_ts")


def _scan_locks(spark, sf_dir):
    return M.scan_locks(_locks(spark, sf_dir), 20000, 50).select("user_key", "start_ts", "ttl")


def _load_lock(spark, sf_dir):
    return M.load_lock(_locks(spark, sf_dir), "000000000014").select("user_key", "start_ts", "lock_type", "ttl")


def _of_txn(spark, sf_dir):
    top = _locks(spark, sf_dir).agg(F.max("start_ts").alias("start_ts"))
    return M.locks_of(_locks(spark, sf_dir), top).select("user_key", "start_ts")


def _split(spark, sf_dir):
    """History whose larger values lie in a table of their own."""
    rows = _h(spark, sf_dir)
    writes = rows.withColumn("short_value", F.when(F.col("short_value") <= SMALL_VALUE, F.col("short_value")))
    return writes, rows.filter((F.col("write_type") == "P") & (F.col("short_value") > SMALL_VALUE)).select("user_key", "start_ts", F.col("short_value").alias("value"))


def _large(spark, sf_dir):
    writes, values = _split(spark, sf_dir)
    return M.with_value(M.snapshot(writes, READ_TS), values).select("user_key", "commit_ts", "value")


def _statistics(spark, sf_dir):
    return M.scan_statistics(_h(spark, sf_dir), _locks(spark, sf_dir), READ_TS)


def _gc(keep, spark, sf_dir):
    rows = (G.survivors if keep else G.deleted)(_h(spark, sf_dir), SAFE_POINT)
    return rows.select("user_key", "commit_ts", "write_type")


def _orphans(spark, sf_dir):
    writes, values = _split(spark, sf_dir)
    return G.orphan_values(writes, values, SAFE_POINT)


def _invariance(spark, sf_dir):
    rows = _h(spark, sf_dir)
    key = ["user_key", "commit_ts", "short_value"]
    before, after = M.snapshot(rows, 14000).select(*key), M.snapshot(G.survivors(rows, SAFE_POINT), 14000).select(*key)
    counts = before.agg(F.count(F.lit(1)).alias("n_before")).withColumn("one", F.lit(1)).join(after.agg(F.count(F.lit(1)).alias("n_after")).withColumn("one", F.lit(1)), "one")
    changed = before.exceptAll(after).unionAll(after.exceptAll(before)).agg(F.count(F.lit(1)).alias("n_changed")).withColumn("one", F.lit(1))
    return counts.join(changed, "one").drop("one")


def _delete_range(spark, sf_dir):
    return G.delete_range(_h(spark, sf_dir), "user_key", "000000000020", "000000000100").select("user_key", "commit_ts", "write_type")


_SEEN = "user_key, commit_ts, short_value"
_BIG = f"(SELECT user_key, start_ts, short_value AS value FROM h WHERE write_type = 'P' AND short_value > {SMALL_VALUE})"
_KEPT = f"(SELECT h.*, h.commit_ts > {SAFE_POINT} OR k.commit_ts IS NOT NULL AS survives FROM h LEFT JOIN {visible(SAFE_POINT)} k USING (user_key, commit_ts))"

QUERIES = {
    "mvcc_snapshot": (_snapshot, f"WITH {H} SELECT {_SEEN} FROM {visible(READ_TS)}"),
    "mvcc_point_get": (_point, f"WITH {H} SELECT {_SEEN} FROM {visible(READ_TS)} WHERE user_key = '000000000014'"),
    "mvcc_batch_get": (_batch, f"WITH {H}, k AS (SELECT n_nationkey AS n FROM nation UNION ALL SELECT r_regionkey FROM region) SELECT {_SEEN} FROM k JOIN {visible(READ_TS)} ON user_key = lpad(n::VARCHAR, 12, '0')"),
    "mvcc_scan_range": (partial(_scan, False, False), f"WITH {H} SELECT {_SEEN} FROM {visible(READ_TS)} WHERE user_key >= '000000000010' AND user_key < '000000000090'"),
    "mvcc_scan_desc": (partial(_scan, True, False), f"WITH {H} SELECT {_SEEN} FROM {visible(READ_TS)} WHERE user_key >= '000000000010' AND user_key < '000000000090' ORDER BY user_key DESC"),
    "mvcc_key_only": (partial(_scan, False, True), f"WITH {H} SELECT user_key FROM {visible(READ_TS)} WHERE user_key >= '000000000010' AND user_key < '000000000090'"),
    "mvcc_seek_write": (_seek, f"WITH {H} SELECT user_key, max(commit_ts) AS commit_ts, arg_max(write_type, commit_ts) AS write_type FROM h WHERE commit_ts <= {READ_TS} GROUP BY user_key"),
    "mvcc_commit_record": (_record, f"WITH {H} SELECT user_key, start_ts, commit_ts, write_type FROM h WHERE start_ts IN (SELECT c_custkey FROM customer)"),
    "mvcc_lock_conflicts": (partial(_conflicts, False), f"WITH {L} SELECT user_key, start_ts, lock_type FROM locks WHERE lock_type <> 'S' AND start_ts <= 20000"),
    "mvcc_bypass_locks": (
        partial(_conflicts, True),
        f"WITH {L} SELECT user_key, start_ts, lock_type FROM locks WHERE lock_type <> 'S' AND start_ts <= 20000 AND start_ts NOT IN (SELECT start_ts FROM locks ORDER BY start_ts LIMIT 5)",
    ),
    "mvcc_rc_read": (_committed, f"WITH {H}, {L}, {W} SELECT {_SEEN} FROM {visible(1 << 60, 'writes')}"),
    "mvcc_read_with_locks": (
        _with_locks,
        f"""WITH {H}, {L}, {W} SELECT user_key, CASE WHEN lock_ts IS NULL THEN 'ok' ELSE 'locked' END AS status, CASE WHEN lock_ts IS NULL THEN short_value END AS short_value, lock_ts
        FROM {visible(20000, 'writes')} FULL JOIN (SELECT user_key, start_ts AS lock_ts FROM locks WHERE lock_type <> 'S' AND start_ts <= 20000) USING (user_key)""",
    ),
    "mvcc_scan_locks": (_scan_locks, f"WITH {L} SELECT user_key, start_ts, ttl FROM locks WHERE start_ts <= 20000 ORDER BY user_key LIMIT 50"),
    "mvcc_load_lock": (_load_lock, f"WITH {L} SELECT user_key, start_ts, lock_type, ttl FROM locks WHERE user_key = '000000000014'"),
    "mvcc_locks_of_txn": (_of_txn, f"WITH {L} SELECT user_key, start_ts FROM locks WHERE start_ts = (SELECT max(start_ts) FROM locks)"),
    "mvcc_large_value_lookup": (_large, f"WITH {H} SELECT v.user_key, commit_ts, coalesce(CASE WHEN short_value <= {SMALL_VALUE} THEN short_value END, b.value) AS value FROM {visible(READ_TS)} v LEFT JOIN {_BIG} b USING (user_key, start_ts)"),
    "mvcc_scan_statistics": (_statistics, f"WITH {H}, {L} SELECT (SELECT count(*) FROM h) AS scanned, (SELECT count(*) FROM {visible(READ_TS)}) AS processed, (SELECT count(*) FROM locks WHERE lock_type <> 'S' AND start_ts <= {READ_TS}) AS locks_met"),
    "gc_survivors": (partial(_gc, True), f"WITH {H} SELECT user_key, commit_ts, write_type FROM {_KEPT} WHERE survives"),
    "gc_deleted": (partial(_gc, False), f"WITH {H} SELECT user_key, commit_ts, write_type FROM {_KEPT} WHERE NOT survives"),
    "gc_orphan_values": (_orphans, f"WITH {H} SELECT user_key, start_ts, short_value AS value FROM {_KEPT} WHERE NOT survives AND write_type = 'P' AND short_value > {SMALL_VALUE}"),
    "gc_snapshot_invariance": (_invariance, f"WITH {H} SELECT count(*) AS n_before, count(*) AS n_after, 0::BIGINT AS n_changed FROM {visible(14000)}"),
    "gc_delete_range": (_delete_range, f"WITH {H} SELECT user_key, commit_ts, write_type FROM h WHERE NOT (user_key >= '000000000020' AND user_key < '000000000100')"),
}
