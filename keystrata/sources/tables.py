"""Parquet tables, their versions, and the multi-version history that an event table stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_version(table: DataFrame, root: str, version: int, key: str | None = None) -> str:
    """Write a table as a new version beside the older ones, range-partitioned and sorted by key.

    A version is never overwritten, so readers of older ones aren't disturbed.
    """
    path = f"{root}/version={version}"
    out = table.repartitionByRange(key).sortWithinPartitions(key) if key else table
    out.write.mode("error").parquet(path)
    return path


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/version={version}")


def byte_key(number: Column | str) -> Column:
    """A number as zero-padded text, which sorts as the number does."""
    column = F.col(number) if isinstance(number, str) else number
    return F.lpad(column.cast("string"), 12, "0")


def history(events: DataFrame) -> DataFrame:
    """Write records: one transaction for each event, on its user's key."""
    kind = F.when(F.col("event_type") == "click", "D").when(F.col("event_type") == "view", "L").when(F.col("event_type") == "error", "R").otherwise("P")
    return events.select(
        byte_key("user_id").alias("user_key"), (F.col("event_id") * 2 + 2).alias("commit_ts"), (F.col("event_id") * 2 + 1).alias("start_ts"), kind.alias("write_type"), F.col("value").alias("short_value"), "props"
    )


def pending(events: DataFrame) -> DataFrame:
    """Locks: each user's newest event as a transaction that hasn't ended."""
    newest = events.groupBy("user_id").agg(F.max(F.struct("event_id", "event_type", "value")).alias("e")).select("user_id", "e.*")
    kind = F.when(F.col("event_type") == "click", "D").when(F.col("event_type") == "view", "L").when(F.col("event_type") == "error", "S").otherwise("P")
    start = F.col("event_id") * 2 + 1
    return newest.select(
        byte_key("user_id").alias("user_key"), kind.alias("lock_type"), byte_key(F.floor(F.col("user_id") / 10) * 10).alias("primary_key"), start.alias("start_ts"),
        (F.lit(3000) + F.col("user_id")).alias("ttl"), start.alias("for_update_ts"), (start + 1).alias("min_commit_ts"), F.col("value").alias("short_value"),
    )


def ended(events: DataFrame) -> DataFrame:
    """Write records of all events but each user's newest, which is pending."""
    newest = events.groupBy("user_id").agg(F.max("event_id").alias("_last"))
    return history(events.join(newest, "user_id").filter(F.col("event_id") < F.col("_last")))


def raw_orders(orders: DataFrame) -> DataFrame:
    """Orders as key-value pairs that expire at an even spread of times or never."""
    return orders.select(
        byte_key("o_orderkey").alias("key"), F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("value"), F.when(F.col("o_orderstatus") != "O", F.col("o_custkey") % 1000).alias("expire_ts")
    )
