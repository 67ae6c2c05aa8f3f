"""Reads of multi-version data.

Tables: writes (user_key, commit_ts, start_ts, write_type P/D/L/R, short_value), values
(user_key, start_ts, value) for what is too long to lie in the write, and locks (user_key,
lock_type P/D/L/S, primary_key, start_ts, ttl, for_update_ts, min_commit_ts, ...).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.operators.pipeline import Bound, in_range

DATA = ("P", "D")


def _newest(writes: DataFrame) -> DataFrame:
    """The newest record of each key; Spark limits each task to one row per key before the shuffle."""
    newest_first = Window.partitionBy("user_key").orderBy(F.desc("commit_ts"))
    return writes.withColumn("_rank", F.row_number().over(newest_first)).filter("_rank = 1").drop("_rank")


def seek_write(writes: DataFrame, read_ts: int | None = None) -> DataFrame:
    """Newest record of any type at or before read_ts (none: the newest of all) for each key."""
    return _newest(writes if read_ts is None else writes.filter(F.col("commit_ts") <= read_ts))


def snapshot(writes: DataFrame, read_ts: int | None = None) -> DataFrame:
    """What a read at read_ts sees: per key the newest put or delete, if it is a put."""
    data = writes.filter(F.col("write_type").isin(*DATA))
    return seek_write(data, read_ts).filter("write_type = 'P'")


def with_value(visible: DataFrame, values: DataFrame) -> DataFrame:
    """Add the value: the short one, or that of the same start timestamp in the values table."""
    long = values.select("user_key", "start_ts", F.col("value").alias("_long"))
    out = visible.join(long, ["user_key", "start_ts"], "left")
    return out.withColumn("value", F.coalesce("short_value", "_long")).drop("_long")


def point_get(writes: DataFrame, key: str | bytes, read_ts: int | None = None) -> DataFrame:
    return snapshot(writes.filter(F.col("user_key") == F.lit(key)), read_ts)


def batch_get(writes: DataFrame, keys: DataFrame, read_ts: int | None = None) -> DataFrame:
    """A row for each requested key that is present; a key asked for twice is returned twice.

    Only versions of requested keys are ranked. Spark broadcasts the key list if its size is small.
    """
    asked = writes.join(keys.select("user_key"), "user_key", "left_semi")
    return keys.select("user_key").join(snapshot(asked, read_ts), "user_key")


def scan(writes: DataFrame, start: Bound = None, end: Bound = None, read_ts: int | None = None, descending: bool = False, key_only: bool = False) -> DataFrame:
    """Visible rows of a half-open range in key order; key_only reads no values."""
    rows = snapshot(writes.filter(in_range(F.col("user_key"), start, end)), read_ts)
    rows = rows.select("user_key") if key_only else rows
    return rows.orderBy(F.desc("user_key") if descending else F.asc("user_key"))


def blocking(read_ts: int | None) -> Column:
    """Whether a lock blocks a read: not pessimistic and not newer than the read."""
    found = F.col("lock_type") != "S"
    return found & (F.col("start_ts") <= read_ts) if read_ts is not None else found


def lock_conflicts(locks: DataFrame, read_ts: int | None, bypass: DataFrame | Sequence[int] = (), start: Bound = None, end: Bound = None) -> DataFrame:
    """Locks that a read under snapshot isolation meets; read-committed reads skip this.

    bypass: start timestamps of transactions whose locks are ignored, as a list or a table (start_ts).
    """
    met = locks.filter(in_range(F.col("user_key"), start, end) & blocking(read_ts))
    if isinstance(bypass, DataFrame):
        return met.join(bypass.select("start_ts"), "start_ts", "left_anti")
    return met.filter(~F.col("start_ts").isin(*bypass)) if bypass else met


def read_with_locks(writes: DataFrame, locks: DataFrame, read_ts: int | None, bypass: DataFrame | Sequence[int] = ()) -> DataFrame:
    """Visible or blocked keys with status "ok" or "locked"; a blocked key has no value."""
    held = lock_conflicts(locks, read_ts, bypass).select("user_key", F.col("start_ts").alias("lock_ts"))
    rows = snapshot(writes, read_ts).join(held, "user_key", "full")
    locked = F.col("lock_ts").isNotNull()
    return rows.withColumns({"status": F.when(locked, "locked").otherwise("ok"), "short_value": F.when(~locked, F.col("short_value"))})


def commit_record(writes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records of any type of the wanted (user_key, start_ts)."""
    return wanted.select("user_key", "start_ts").join(writes, ["user_key", "start_ts"])


def load_lock(locks: DataFrame, key: str | bytes) -> DataFrame:
    return locks.filter(F.col("user_key") == F.lit(key))


def scan_locks(locks: DataFrame, max_ts: int, limit: int, start: Bound = None, end: Bound = None) -> DataFrame:
    """The first locks of a range in key order whose transaction began by max_ts."""
    return locks.filter(in_range(F.col("user_key"), start, end) & (F.col("start_ts") <= max_ts)).orderBy("user_key").limit(limit)


def locks_of(locks: DataFrame, start_ts: DataFrame | int) -> DataFrame:
    """Locks of one transaction, or of all in a table (start_ts)."""
    if isinstance(start_ts, DataFrame):
        return locks.join(start_ts.select("start_ts"), "start_ts", "left_semi")
    return locks.filter(F.col("start_ts") == start_ts)


def seek(writes: DataFrame, key: str | bytes, backward: bool = False) -> DataFrame:
    """Records of the first stored key at or after a key, or with backward of the last at or before it.

    The key is found by one aggregate, which every task computes over its rows first.
    """
    side = F.col("user_key") <= F.lit(key) if backward else F.col("user_key") >= F.lit(key)
    found = writes.filter(side).agg((F.max if backward else F.min)("user_key").alias("user_key"))
    return writes.join(F.broadcast(found), "user_key", "left_semi")


def scan_statistics(writes: DataFrame, locks: DataFrame, read_ts: int | None = None) -> DataFrame:
    """One row: records scanned, keys returned, locks met."""
    scanned = writes.agg(F.count(F.lit(1)).alias("scanned"))
    processed = snapshot(writes, read_ts).agg(F.count(F.lit(1)).alias("processed"))
    met = lock_conflicts(locks, read_ts).agg(F.count(F.lit(1)).alias("locks_met"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(scanned).join(one(processed), "_one").join(one(met), "_one").drop("_one")
