"""Key codes, delivery in chunks and the safe point over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystrata.functions import codec as C
from keystrata.operators import garbage as G
from keystrata.operators import mvcc as M
from keystrata.sources.tables import history, read
from keystrata.streaming.chunks import chunk_sizes


def _codes(spark, sf_dir):
    """Codes of every line item's columns, as hexadecimal text, and what they decode to."""
    rows = read(spark, sf_dir, "lineitem")
    number, price, text = F.col("l_orderkey") - 5000, F.col("l_extendedprice") - 30000, F.col("l_returnflag").cast("binary")
    codes = {"int64": C.encode_int64(number), "float64": C.encode_float64(price), "varint": C.encode_varint(number), "uvarint": C.encode_uvarint(F.col("l_orderkey")), "bytes": C.encode_bytes(text)}
    coded = rows.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", *[c.alias(n) for n, c in codes.items()])
    back = {"int64_back": C.decode_int64(F.col("int64")), "float64_back": C.decode_float64(F.col("float64")), "varint_back": C.decode_varint(F.col("varint")), "uvarint_back": C.decode_uvarint(F.col("uvarint")), "bytes_back": C.decode_bytes(F.col("bytes")).cast("string")}
    return coded.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", *[F.hex(n).alias(n) for n in codes], *[c.alias(n) for n, c in back.items()])


def _round_trip(spark, sf_dir):
    """Line items whose key codes sort as their numbers do and decode to them."""
    rows = _codes(spark, sf_dir)
    good = (F.col("int64_back") == F.col("l_orderkey") - 5000) & (F.col("varint_back") == F.col("l_orderkey") - 5000) & (F.col("uvarint_back") == F.col("l_orderkey"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("n_good"), F.min("int64").alias("least"), F.max("int64").alias("most"))


def _chunks(spark, sf_dir):
    return chunk_sizes(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


def _safe_point(spark, sf_dir):
    """Collection at a safe point that never goes back: the wanted one lies before the current one."""
    writes = history(read(spark, sf_dir, "events"))
    return G.survivors(writes, G.safe_point(8000, 6000)).select("user_key", "commit_ts", "write_type")


def _seek(backward, spark, sf_dir):
    return M.seek(history(read(spark, sf_dir, "events")), "000000000010x", backward).select("user_key", "commit_ts")


_H = "WITH h AS (SELECT lpad(user_id::VARCHAR, 12, '0') AS user_key, event_id * 2 + 2 AS commit_ts, CASE event_type WHEN 'click' THEN 'D' WHEN 'view' THEN 'L' WHEN 'error' THEN 'R' ELSE 'P' END AS write_type FROM events)"

QUERIES = {
    "codec_codes": (_codes, None),
    "codec_round_trip": (
        _round_trip,
        "SELECT count(*) AS n, count(*) AS n_good, printf('%016X', min(l_orderkey) - 5000 + 9223372036854775808::HUGEINT) AS least, printf('%016X', max(l_orderkey) - 5000 + 9223372036854775808::HUGEINT) AS most FROM lineitem",
    ),
    "stream_chunks": (
        _chunks,
        """WITH n AS (SELECT count(*) AS n FROM orders), c AS (SELECT i, CASE WHEN i < 5 THEN 32 * (2 ** i - 1) ELSE 992 + (i - 5) * 1024 END::BIGINT AS first, CASE WHEN i < 5 THEN 32 * 2 ** i ELSE 1024 END::BIGINT AS size FROM range(0, 1000000) t(i))
        SELECT i AS chunk, least(size, n - first) AS n_rows FROM c, n WHERE first < n""",
    ),
    "gc_safe_point": (
        _safe_point,
        f"{_H}, k AS (SELECT user_key, max(commit_ts) AS kept FROM h WHERE commit_ts <= 8000 AND write_type IN ('P', 'D') GROUP BY user_key) SELECT h.* FROM h LEFT JOIN k USING (user_key) WHERE commit_ts > 8000 OR commit_ts = kept AND write_type = 'P'",
    ),
    "mvcc_seek_key": (lambda spark, sf_dir: _seek(False, spark, sf_dir), f"{_H} SELECT user_key, commit_ts FROM h WHERE user_key = (SELECT min(user_key) FROM h WHERE user_key >= '000000000010x')"),
    "mvcc_seek_for_previous": (lambda spark, sf_dir: _seek(True, spark, sf_dir), f"{_H} SELECT user_key, commit_ts FROM h WHERE user_key = (SELECT max(user_key) FROM h WHERE user_key <= '000000000010x')"),
}
