"""Deliver a result in chunks, so that the driver holds one partition at a time."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def chunks(rows: DataFrame, first: int = 32, most: int = 1024) -> Iterator[list[Row]]:
    """Lists of rows, doubling from `first` to `most` rows; the next partition is fetched meanwhile."""
    source, size = rows.toLocalIterator(prefetchPartitions=True), first
    while chunk := list(islice(source, size)):
        yield chunk
        size = min(2 * size, most)


def chunk_sizes(rows: DataFrame, key: str, first: int = 32, most: int = 1024) -> DataFrame:
    """How many rows each chunk of a result has that is delivered in key order (chunk, n_rows).

    Only the number of rows is needed, and chunks after the growing ones are all alike.
    """
    total = rows.agg(F.count(key).alias("n"))
    growing = [first]
    while growing[-1] * 2 <= most:
        growing.append(growing[-1] * 2)
    before = sum(growing)
    n_chunks = F.when(F.col("n") > before, len(growing) + F.ceil((F.col("n") - before) / most)).otherwise(len(growing))
    chunk = total.select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), n_chunks - 1)).alias("chunk"))
    doubled = F.pow(F.lit(2.0), F.col("chunk")).cast("bigint")
    size = F.when(F.col("chunk") < len(growing), first * doubled).otherwise(most)
    start = F.when(F.col("chunk") < len(growing), first * (doubled - 1)).otherwise(before + (F.col("chunk") - len(growing)) * most)
    return chunk.select("chunk", F.least(size, F.col("n") - start).cast("bigint").alias("n_rows")).filter("n_rows > 0")
