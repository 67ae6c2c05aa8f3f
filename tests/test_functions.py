"""Key encodings, timestamps and checksums."""

from __future__ import annotations

import struct

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keystrata.functions import codec as C
from keystrata.functions.checksum import crc64, crc64_batch
from keystrata.functions.timestamps import compose, expired, logical, physical
from keystrata.plans import codec_queries
from keystrata.streaming.chunks import chunk_sizes, chunks

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SLOW
@given(values=st.lists(st.binary(max_size=20), min_size=1, max_size=30))
def test_bytes_round_trip_and_order(spark, values):
    values = [*values, b"", b"\0", b"\xff" * 8, b"a" * 8, b"a" * 9]
    df = spark.createDataFrame([(bytearray(v),) for v in values], "v binary")
    e, d = C.encode_bytes(F.col("v")), C.encode_bytes_desc(F.col("v"))
    rows = df.select("v", e.alias("e"), d.alias("d"), C.decode_bytes(e).alias("back"), C.decode_bytes_desc(d).alias("back_desc")).collect()
    assert all(bytes(r.v) == bytes(r.back) == bytes(r.back_desc) for r in rows)
    assert [bytes(r.v) for r in sorted(rows, key=lambda r: bytes(r.e))] == sorted(values)
    assert [bytes(r.v) for r in sorted(rows, key=lambda r: bytes(r.d))] == sorted(values, reverse=True)


def test_bytes_reject_what_was_never_encoded(spark):
    bad = [b"", b"12345678", b"\0" * 8 + b"\xf0", b"12\0\0\0\0\0\0\xf8", b"12345678\xff"]
    df = spark.createDataFrame([(bytearray(v),) for v in bad], "v binary")
    assert [r.d for r in df.select(C.decode_bytes(F.col("v")).alias("d")).collect()] == [None] * len(bad)


@SLOW
@given(values=st.lists(st.integers(-(1 << 63), (1 << 63) - 1), min_size=1, max_size=30))
def test_integers_round_trip_and_order(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    e, d = C.encode_int64(F.col("v")), C.encode_int64_desc(F.col("v"))
    rows = df.select("v", e.alias("e"), C.decode_int64(e).alias("back"), C.decode_int64_desc(d).alias("desc")).collect()
    assert all(r.v == r.back == r.desc for r in rows)
    assert [r.v for r in sorted(rows, key=lambda r: bytes(r.e))] == sorted(values)


def test_unsigned(spark):
    df = spark.sql("SELECT cast(v AS decimal(20,0)) AS v FROM VALUES (0), (1), (9223372036854775808), (18446744073709551615) AS t(v)")
    rows = df.select("v", C.decode_uint64(C.encode_uint64(F.col("v"))).alias("back")).collect()
    assert all(r.v == r.back for r in rows)


@SLOW
@given(values=st.lists(st.floats(allow_nan=False), min_size=1, max_size=30))
def test_doubles_round_trip_and_order(spark, values):
    values = [*values, 0.0, -1.5, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 0.1, 1 / 3, 2.0**-1000, 1 - 2.0**-53]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    e = C.encode_float64(F.col("v"))
    rows = df.select("v", e.alias("e"), C.decode_float64(e).alias("back")).collect()
    assert all(r.v == r.back for r in rows)
    bits = [struct.unpack(">Q", struct.pack(">d", r.v + 0.0))[0] for r in rows]
    assert [bytes(r.e) for r in rows] == [((1 << 64) - 1 - b if b >> 63 else b ^ 1 << 63).to_bytes(8, "big") for b in bits]
    assert [r.v for r in sorted(rows, key=lambda r: bytes(r.e))] == sorted(r.v for r in rows)


@SLOW
@given(values=st.lists(st.integers(-(1 << 63), (1 << 63) - 1), min_size=1, max_size=30))
def test_varints_round_trip(spark, values):
    values = [*values, 0, 1, -1, 127, 128, (1 << 63) - 1, -(1 << 63)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    s, u = C.encode_varint(F.col("v")), C.encode_uvarint(F.col("v"))
    rows = df.select("v", s.alias("s"), u.alias("u"), C.decode_varint(s).alias("back"), C.decode_uvarint(u).alias("unsigned")).collect()
    assert all(r.v == r.back == r.unsigned for r in rows)
    for r in rows:
        number = sum((b & 127) << 7 * i for i, b in enumerate(r.u))
        assert number == r.v % (1 << 64) and all(b >= 128 for b in r.u[:-1]) and r.u[-1] < 128
        assert len(r.s) <= 1 + abs(r.v).bit_length() // 7


def test_varints_reject_what_was_never_encoded(spark):
    bad = [b"", b"\x80", b"\x01\x01", b"\xff" * 10, b"\x80" * 11]
    df = spark.createDataFrame([(bytearray(v),) for v in bad], "v binary")
    assert [r.d for r in df.select(C.decode_uvarint(F.col("v")).alias("d")).collect()] == [None] * len(bad)


def test_chunk_sizes(spark):
    for n in (0, 1, 32, 33, 1000, 5000):
        rows = spark.range(n)
        sizes = [r.n_rows for r in chunk_sizes(rows, "id").orderBy("chunk").collect()]
        assert sizes == [len(c) for c in chunks(rows)]


def test_timestamps(spark):
    ts = compose(F.lit(1700000000123), F.lit(77))
    row = spark.range(1).select(physical(ts).alias("p"), logical(ts).alias("l"), expired(ts, F.lit(3000), compose(F.lit(1700000003123), F.lit(0))).alias("late")).first()
    assert tuple(row) == (1700000000123, 77, True)


def test_crc64(spark):
    assert int(crc64_batch([b"123456789"])[0]) & ((1 << 64) - 1) == 0x995DC9BBDF1939FA  # the published check value
    values = [b"", b"a", b"abc" * 100, b"123456789"]
    df = spark.createDataFrame([(bytearray(v),) for v in values] + [(None,)], "v binary")
    got = [r.c for r in df.select(crc64(F.col("v")).alias("c")).collect()]
    assert got == [int(crc64_batch([v])[0]) for v in values] + [None]


def test_codes_are_computed_once_for_a_row(spark, sf_dir):
    """Decoding refers to a code many times; the plan must not repeat how it is made each time."""
    for name in ("codec_codes", "codec_round_trip"):
        rows = codec_queries.QUERIES[name][0](spark, sf_dir)
        assert len(rows._jdf.queryExecution().optimizedPlan().toString()) < 60_000


def test_codes_of_many_groups(spark):
    values = [bytes(range(256)) * k + b"\xff" * j for k in (0, 1, 40) for j in range(18)]
    codes = [b"".join(v[i : i + 8].ljust(8, b"\0") + bytes([255 - 8 + len(v[i : i + 8])]) for i in range(0, len(v) + 1, 8)) for v in values]
    bad = [c[:i] + bytes([c[i] ^ flip]) + c[i + 1 :] for c in (codes[8], codes[17], codes[20]) for i in range(len(c)) if i % 9 == 8 or i > len(c) - 4 for flip in (1, 2, 128)]
    df = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values + codes + bad)], "i int, v binary")
    rows = sorted(df.select("i", C.encode_bytes(F.col("v")).alias("e"), C.decode_bytes(F.col("v")).alias("d")).collect())
    n = len(values)
    assert [bytes(r.e) for r in rows[:n]] == codes and [bytes(r.d) for r in rows[n : 2 * n]] == values
    known = dict(zip(codes, values, strict=True))

    def decoded(c):
        groups = [c[i : i + 9] for i in range(0, len(c), 9)]
        v = b"".join(g[: max(g[8] - 247, 0)] for g in groups)
        again = b"".join(v[i : i + 8].ljust(8, b"\0") + bytes([247 + len(v[i : i + 8])]) for i in range(0, len(v) + 1, 8))
        return known.get(c, v if again == c else None)

    assert [r.d and bytes(r.d) for r in rows[2 * n :]] == [decoded(c) for c in bad]
