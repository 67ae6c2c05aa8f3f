"""Every key-value query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import struct
import zlib
from functools import reduce
from operator import xor

import duckdb
import pandas as pd
import pytest

from keystrata import catalog
from keystrata.functions.checksum import POLYNOMIAL
from keystrata.plans import raw_queries
from keystrata.sources.tables import ended, pending, raw_orders, read

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _rows(frame: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NA or (not isinstance(v, str) and pd.isna(v)):
            return ""
        return f"{float(v):.9g}" if not isinstance(v, (str, bool)) else str(v)

    return sorted(tuple(text(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got, want = catalog.queries()[name](spark, sf_dir).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_checksums_over_whole_tables(spark, sf_dir):
    """Row by row: CRC-64 bit by bit from its polynomial, CRC-32 by the standard library."""
    total = [0, 0, 0]
    for r in raw_orders(read(spark, sf_dir, "orders")).collect():
        if raw_queries.LOW <= r.key < raw_queries.HIGH and (r.expire_ts is None or r.expire_ts > raw_queries.NOW):
            crc, data = (1 << 64) - 1, (r.key + r.value).encode()
            for byte in data:
                crc ^= byte
                for _ in range(8):
                    crc = crc >> 1 ^ (POLYNOMIAL if crc & 1 else 0)
            total = [total[0] ^ crc ^ (1 << 64) - 1, total[1] + 1, total[2] + len(data)]
    got = catalog.queries()["raw_checksum"](spark, sf_dir).first()
    assert [got.checksum % (1 << 64), got.total_kvs, got.total_bytes] == total
    events = read(spark, sf_dir, "events")
    want = {}
    for name, rows, kind in (("write", ended(events), "write_type"), ("lock", pending(events), "lock_type")):
        crcs = [zlib.crc32((r.user_key + r[kind]).encode()) for r in rows.collect()]
        want[name] = (reduce(xor, crcs), len(crcs))
    assert {r.family: (r.checksum, r.n_rows) for r in catalog.queries()["region_export"](spark, sf_dir).collect()} == want


def test_codes_over_a_whole_table(spark, sf_dir):
    def ordered(number):
        return (number + (1 << 63)).to_bytes(8, "big")

    def varint(number, zigzag):
        number = (number << 1) ^ (number >> 63) if zigzag else number
        out = []
        while True:
            out.append(number & 127 | (128 if number > 127 else 0))
            number >>= 7
            if not number:
                return bytes(out)

    def double(x):
        bits = struct.unpack(">Q", struct.pack(">d", x))[0]
        return ((1 << 64) - 1 - bits if bits >> 63 else bits ^ 1 << 63).to_bytes(8, "big")

    rows = catalog.queries()["codec_codes"](spark, sf_dir).collect()
    assert len(rows) == read(spark, sf_dir, "lineitem").count()
    for r in rows:
        number, price = r.l_orderkey - 5000, r.l_extendedprice - 30000
        assert [bytes.fromhex(x) for x in (r.int64, r.float64, r.varint, r.uvarint)] == [ordered(number), double(price), varint(number, True), varint(r.l_orderkey, False)]
        assert (r.int64_back, r.float64_back, r.varint_back, r.uvarint_back, r.bytes_back) == (number, price, number, r.l_orderkey, r.l_returnflag)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
