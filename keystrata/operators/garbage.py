"""Garbage collection of versions.

What lies at or before the safe point is dropped, except each key's newest put or delete there,
if it is a put. Reads at or after the safe point see the same as before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.operators.mvcc import snapshot
from keystrata.operators.pipeline import Bound, in_range


def _judged(writes: DataFrame, safe_point: int) -> DataFrame:
    kept = snapshot(writes, safe_point).select("user_key", F.col("commit_ts").alias("_kept"))
    return writes.join(kept, "user_key", "left").withColumn("_survives", (F.col("commit_ts") > safe_point) | F.coalesce(F.col("commit_ts") == F.col("_kept"), F.lit(False)))


def survivors(writes: DataFrame, safe_point: int) -> DataFrame:
    """Records that stay."""
    return _judged(writes, safe_point).filter("_survives").drop("_kept", "_survives")


def deleted(writes: DataFrame, safe_point: int) -> DataFrame:
    """Records that go."""
    return _judged(writes, safe_point).filter("not _survives").drop("_kept", "_survives")


def orphan_values(writes: DataFrame, values: DataFrame, safe_point: int) -> DataFrame:
    """Long values whose put goes."""
    gone = deleted(writes, safe_point).filter("write_type = 'P' and short_value is null").select("user_key", "start_ts")
    return values.join(gone, ["user_key", "start_ts"], "left_semi")


def safe_point(current: int, wanted: int) -> int:
    """The safe point never goes back."""
    return max(current, wanted)


def delete_range(table: DataFrame, key: str, start: Bound, end: Bound) -> DataFrame:
    """What stays when a half-open key range is dropped."""
    return table.filter(~in_range(F.col(key), start, end))
