"""Key-range metadata: sizes, split keys, lookup, placement and store states."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds without a heartbeat after which a store counts as disconnected or down.
DISCONNECTED_S, DOWN_S = 30, 30 * 60
#: Bytes of boundaries that are broadcast; of a larger set, a sample of so many bytes forms blocks.
BROADCAST_BYTES = 8 << 20
#: Rows of a block of keys that are counted in order, on average.
BLOCK_ROWS = 1 << 16


def regions_from(boundaries: DataFrame) -> DataFrame:
    """Ranges (region_id, start_key, end_key) between sorted distinct boundaries (key); the ends are open.

    Region metadata is small next to the data, one row for about a hundred megabytes, so one task
    numbers it: a million rows for a hundred terabytes.
    """
    starts = boundaries.select(F.col("key").alias("start_key")).distinct().unionByName(boundaries.sparkSession.createDataFrame([("",)], "start_key string"))
    in_order = Window.orderBy("start_key")
    return starts.select(F.row_number().over(in_order).alias("region_id"), "start_key", F.lead("start_key").over(in_order).alias("end_key"))


def _placed(rows: DataFrame, key: str, starts: list[tuple[str, int]], into: str) -> DataFrame:
    """Rows with the number of the last start at or before their key, by binary search in the sorted starts."""
    sent = rows.sparkSession.sparkContext.broadcast(([s.encode() for s, _ in starts], [n for _, n in starts]))

    @F.arrow_udf("long")
    def place(keys: pa.Array) -> pa.Array:
        bounds, numbers = sent.value
        found = [bisect_right(bounds, k.encode()) - 1 if k is not None else -1 for k in keys.to_pylist()]
        return pa.array([numbers[i] if i >= 0 else None for i in found], pa.int64())

    return rows.withColumn(into, place(F.col(key)))


def cuts(keys: DataFrame) -> list[str]:
    """Keys that cut a table into blocks: one of BLOCK_ROWS distinct ones, chosen by its hash, and the open start."""
    found = keys.filter(F.pmod(F.xxhash64("key"), F.lit(BLOCK_ROWS)) == 0).select("key").distinct().collect()
    return ["", *sorted((r["key"] for r in found if r["key"]), key=str.encode)]


def located(rows: DataFrame, starts: list[str], into: str) -> DataFrame:
    """Rows with the number of the block, between sorted starts, that holds their key."""
    return _placed(rows, "key", [(s, i) for i, s in enumerate(starts)], into)


def lookup(keys: DataFrame, regions: DataFrame, key: str = "key") -> DataFrame:
    """Every key with the id of its region; keys before the first region or null are left out.

    Up to BROADCAST_BYTES of boundaries are sent to the tasks, which search them. Of a larger set a
    hashed sample of boundaries is sent, which cuts keys and regions into blocks; within a block, in
    the order of keys and boundaries, each key takes the boundary before it.
    """
    n_bytes = regions.agg(F.coalesce(F.sum(F.octet_length("start_key") + 16), F.lit(0))).first()[0]
    if n_bytes <= BROADCAST_BYTES:
        starts = sorted((r["start_key"].encode(), r["start_key"], r["region_id"]) for r in regions.select("start_key", "region_id").collect())
        placed = _placed(keys, key, [(s, n) for _, s, n in starts], "region_id")
        return placed.filter(F.col("region_id").isNotNull())
    one_of = -(-2 * n_bytes // BROADCAST_BYTES)
    least = regions.agg(F.min("start_key")).first()[0]
    sample = regions.filter((F.pmod(F.xxhash64("start_key"), F.lit(one_of)) == 0) | (F.col("start_key") == least)).select("start_key").distinct().collect()
    starts = [(r["start_key"], i) for i, r in enumerate(sorted(sample, key=lambda r: r["start_key"].encode()))]
    bounds = _placed(regions.select(F.col("start_key").alias("_at"), F.col("region_id").cast("bigint").alias("_id")), "_at", starts, "_block")
    rows = _placed(keys.withColumn("_at", F.col(key)), "_at", starts, "_block").filter(F.col("_block").isNotNull())
    both = rows.unionByName(bounds, allowMissingColumns=True)
    before = Window.partitionBy("_block").orderBy(F.col("_at"), F.col("_id").isNull())
    found = both.withColumn("region_id", F.last("_id", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return found.filter(F.col("_id").isNull()).drop("_at", "_block", "_id")


def sizes(located: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Bytes and rows of each region."""
    return located.groupBy("region_id").agg(F.sum(F.octet_length(key) + F.octet_length(value)).alias("n_bytes"), F.count(F.lit(1)).alias("n_keys"))


def split_keys(located: DataFrame, split_bytes: int, key: str = "key", value: str = "value") -> DataFrame:
    """Where to split regions larger than split_bytes: the first key at which half of that is passed.

    A region's rows are ordered in one task; regions have a bounded size by definition.
    """
    in_order = Window.partitionBy("region_id").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    summed = located.withColumn("_upto", F.sum(F.octet_length(key) + F.octet_length(value)).over(in_order))
    return summed.groupBy("region_id").agg(F.max("_upto").alias("n_bytes"), F.min(F.when(F.col("_upto") * 2 >= split_bytes, F.col(key))).alias("split_key")).filter(F.col("n_bytes") > split_bytes)


def split(regions: DataFrame, cuts: DataFrame) -> DataFrame:
    """Regions cut at the keys of (region_id, key); versions rise by the number of cuts."""
    inner = cuts.join(regions, "region_id").filter((F.col("key") > F.col("start_key")) & (F.col("end_key").isNull() | (F.col("key") < F.col("end_key"))))
    starts = inner.select("region_id", F.col("key").alias("start_key")).distinct().unionByName(regions.select("region_id", "start_key"))
    in_order = Window.partitionBy("region_id").orderBy("start_key")
    pieces = starts.select("region_id", "start_key", F.lead("start_key").over(in_order).alias("_next"), F.count(F.lit(1)).over(Window.partitionBy("region_id")).alias("_n"))
    whole = regions.select("region_id", F.col("end_key").alias("_end"), "version")
    return pieces.join(whole, "region_id").select("region_id", "start_key", F.coalesce("_next", "_end").alias("end_key"), (F.col("version") + F.col("_n") - 1).alias("version"))


def merge(regions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Merged regions of adjacent pairs (left_id, right_id): both ranges, the greater version plus one."""
    left = regions.select(F.col("region_id").alias("left_id"), "start_key", F.col("end_key").alias("_middle"), F.col("version").alias("_v1"))
    right = regions.select(F.col("region_id").alias("right_id"), F.col("start_key").alias("_from"), "end_key", F.col("version").alias("_v2"))
    return pairs.join(left, "left_id").join(right, "right_id").filter("_middle = _from").select(F.col("left_id").alias("region_id"), "start_key", "end_key", (F.greatest("_v1", "_v2") + 1).alias("version"))


def count_per_store(regions: DataFrame) -> DataFrame:
    """Regions and leaders of each store, from (region_id, peers array, leader)."""
    each = regions.select("leader", F.explode("peers").alias("store_id"))
    return each.groupBy("store_id").agg(F.count(F.lit(1)).alias("n_regions"), F.sum((F.col("leader") == F.col("store_id")).cast("bigint")).alias("n_leaders"))


def store_states(stores: DataFrame, now: int) -> DataFrame:
    """State of stores (store_id, last_heartbeat in seconds, tombstone) by the age of the heartbeat."""
    age = F.lit(now) - F.col("last_heartbeat")
    state = F.when(F.col("tombstone"), "tombstone").when(age > DOWN_S, "down").when(age > DISCONNECTED_S, "disconnected").otherwise("up")
    return stores.withColumn("state", state)


def imbalance(counts: DataFrame, by: str, threshold: float) -> DataFrame:
    """Stores whose count lies above the mean by more than a share of it: candidates to give up regions."""
    mean = counts.agg(F.avg(by).alias("_mean"))
    return counts.join(F.broadcast(mean)).filter(F.col(by) > F.col("_mean") * (1 + threshold)).drop("_mean")


def range_checksum(tables: Sequence[tuple[str, DataFrame]], key: str = "key", value: str = "value") -> DataFrame:
    """CRC-32 of each family's rows, combined by exclusive or, for exported snapshots."""
    parts = [t.select(F.lit(name).alias("family"), F.crc32(F.concat(F.col(key).cast("binary"), F.col(value).cast("binary"))).alias("crc")) for name, t in tables]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionAll(part)
    return rows.groupBy("family").agg(F.bit_xor("crc").alias("checksum"), F.count(F.lit(1)).alias("n_rows"))
