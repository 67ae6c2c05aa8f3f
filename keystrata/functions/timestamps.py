"""Hybrid timestamps: milliseconds in the upper bits, a counter in the lower LOGICAL_BITS."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by the timestamp format.
LOGICAL_BITS = 18


def compose(physical: Column, logical: Column) -> Column:
    return F.shiftleft(physical.cast("bigint"), LOGICAL_BITS).bitwiseOR(logical.cast("bigint"))


def physical(ts: Column) -> Column:
    return F.shiftrightunsigned(ts.cast("bigint"), LOGICAL_BITS)


def logical(ts: Column) -> Column:
    return ts.cast("bigint").bitwiseAND(F.lit((1 << LOGICAL_BITS) - 1))


def expired(start_ts: Column, ttl: Column, now_ts: Column) -> Column:
    """Whether a lock's time to live has passed."""
    return physical(now_ts) >= physical(start_ts) + ttl
