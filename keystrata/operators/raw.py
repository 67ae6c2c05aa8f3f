"""Non-versioned key-value tables: (key, value, expire_ts), expire_ts in seconds or null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions.checksum import crc64
from keystrata.operators.pipeline import Bound, in_range
from keystrata.operators.regions import BROADCAST_BYTES, cuts, located, lookup, regions_from


def is_live(now: int) -> Column:
    """Not expired at `now`, in seconds."""
    return F.col("expire_ts").isNull() | (F.col("expire_ts") > now)


def live(table: DataFrame, now: int) -> DataFrame:
    return table.filter(is_live(now))


def get(table: DataFrame, key: str | bytes, now: int) -> DataFrame:
    return live(table.filter(F.col("key") == F.lit(key)), now)


def batch_get(table: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """Present, unexpired pairs; a key asked for twice is returned twice."""
    return keys.select("key").join(live(table, now), "key")


def put_changes(batch: DataFrame, now: int) -> DataFrame:
    """Change set (op, key, value, expire_ts) of a batch (key, value, ttl, seq): the last row of a key wins. ttl 0 or null: for ever."""
    last_first = Window.partitionBy("key").orderBy(F.desc("seq"))
    last = batch.withColumn("_rank", F.row_number().over(last_first)).filter("_rank = 1")
    return last.select(F.lit("put").alias("op"), "key", "value", F.when(F.col("ttl") > 0, F.lit(now) + F.col("ttl")).cast("bigint").alias("expire_ts"))


def delete_changes(keys: DataFrame) -> DataFrame:
    """Change set that deletes keys; a key asked for twice goes once."""
    return keys.select(F.lit("delete").alias("op"), "key", F.lit(None).cast("string").alias("value"), F.lit(None).cast("bigint").alias("expire_ts")).distinct()


def apply_changes(table: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after a change set, which has each key once."""
    kept = table.select("key", "value", "expire_ts").join(changes.select("key"), "key", "left_anti")
    return kept.unionByName(changes.filter("op = 'put'").select("key", "value", "expire_ts"))


def batch_put(table: DataFrame, batch: DataFrame, now: int) -> DataFrame:
    """The table after writing a batch (key, value, ttl, seq)."""
    return apply_changes(table, put_changes(batch, now))


def batch_delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    return apply_changes(table, delete_changes(keys))


def in_family(families: dict[str, DataFrame], family: str | None = None) -> DataFrame:
    """The table of a column family; none means the default one, unknown names are refused."""
    name = family or "default"
    if name not in families:
        raise ValueError(f"no column family {name}")
    return families[name]


def delete_range(table: DataFrame, start: Bound, end: Bound) -> DataFrame:
    return table.filter(~in_range(F.col("key"), start, end))


def scan(table: DataFrame, now: int, start: Bound = None, end: Bound = None, limit: int = 0, key_only: bool = False, reverse: bool = False) -> DataFrame:
    """Live pairs of [start, end) in key order, at most limit (0: all); reverse goes from the end down."""
    rows = live(table.filter(in_range(F.col("key"), start, end)), now)
    rows = rows.select("key") if key_only else rows.select("key", "value")
    rows = rows.orderBy(F.desc("key") if reverse else F.asc("key"))
    return rows.limit(limit) if limit else rows


def batch_scan(table: DataFrame, ranges: DataFrame | Sequence[tuple[Bound, Bound]], each_limit: int, now: int) -> DataFrame:
    """The first each_limit live pairs of every range, with the range's number.

    ranges: a table (range_id, start, end), null for open ends, or a list of (start, end). Of few ranges, the
    bounds cut the keys into segments, and every task keeps each_limit rows of a segment before any shuffle. Then
    keys and bounds are counted in order, and a range takes the keys of its positions: no range meets a key
    that it doesn't return, however many overlap.
    """
    if not isinstance(ranges, DataFrame):
        rows = [(i, *bounds) for i, bounds in enumerate(ranges)]
        ranges = table.sparkSession.createDataFrame(rows, "range_id int, start string, end string")
    pairs = live(table, now).filter(F.col("key").isNotNull()).select("key", "value")
    bounds = ranges.select(F.explode(F.array("start", "end")).alias("key")).filter("key > ''")
    rows = pairs
    if bounds.agg(F.coalesce(F.sum(F.octet_length("key") + 16), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        first = Window.partitionBy("region_id").orderBy("key")
        rows = lookup(pairs, regions_from(bounds.distinct())).withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= each_limit).select("key", "value")
    ends = ranges.select("range_id", F.coalesce("start", F.lit("")).alias("start"), "end")
    asked = ends.select("*", F.explode(F.array("start", "end")).alias("key")).filter("key IS NOT NULL")
    keys, bounds = _positions(rows, asked, cuts(pairs.select("key").unionByName(bounds)))
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    met = bounds.groupBy("range_id", "start", "end").agg(F.min(F.when(F.col("key") == F.col("start"), F.col("_at"))).alias("_from"), F.min(F.when(F.col("key") == F.col("end"), F.col("_at"))).alias("_to"))
    until = F.least(F.col("_from") + each_limit, F.coalesce("_to", "_total"))
    met = met.join(F.broadcast(total)).withColumn("_to", until).filter("_from < _to").select("range_id", F.explode(F.sequence("_from", F.col("_to") - 1)).alias("_at"))
    return keys.join(met, "_at").select("range_id", "key", "value")


def _positions(keys: DataFrame, bounds: DataFrame, starts: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables with _at: how many of keys come before a row's key, counted in blocks that starts cut."""
    both = located(keys.withColumn("_is_key", F.lit(1)).unionByName(bounds.withColumn("_is_key", F.lit(0)), allowMissingColumns=True), starts, "_block")
    sizes = both.groupBy("_block").agg(F.sum("_is_key").alias("_n"))  # a row for each block
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    # Bounds come before an equal key, as ranges are half-open.
    before = Window.partitionBy("_block").orderBy("key", "_is_key").rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("_at", F.sum("_is_key").over(before)).join(F.broadcast(base), "_block").withColumn("_at", F.col("_at") + F.col("_base") - F.col("_is_key"))
    return counted.filter("_is_key = 1").select("key", "value", "_at"), counted.filter("_is_key = 0").select(*bounds.columns, "_at")


def key_ttl(table: DataFrame, now: int) -> DataFrame:
    """Seconds that each live key has left; 0 without expiry."""
    return live(table, now).select("key", F.coalesce(F.col("expire_ts") - now, F.lit(0)).cast("bigint").alias("ttl"))


def compare_and_swap(table: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """Outcome of requests (key, expected, value): success and the previous value.

    A null expectation means absent; an expired key counts as absent. Requests of one batch have
    different keys; batch_put or batch_delete then apply the successful ones.
    """
    current = live(table, now).select("key", F.col("value").alias("previous"))
    return requests.join(current, "key", "left").withColumn("success", F.col("previous").eqNullSafe(F.col("expected")))


def checksum(table: DataFrame, now: int, start: Bound = None, end: Bound = None) -> DataFrame:
    """One row: exclusive or of CRC-64 over key and value, number of live pairs, and their bytes."""
    rows = live(table.filter(in_range(F.col("key"), start, end)), now).select(F.col("key").cast("binary").alias("k"), F.col("value").cast("binary").alias("v"))
    return rows.select(crc64(F.concat("k", "v")).alias("crc"), (F.octet_length("k") + F.octet_length("v")).alias("n")).agg(
        F.coalesce(F.bit_xor("crc"), F.lit(0)).alias("checksum"), F.count(F.lit(1)).alias("total_kvs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_bytes")
    )
