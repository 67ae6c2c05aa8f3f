"""Push-down pipelines and expressions on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from keystrata.functions import expressions as E
from keystrata.operators import pipeline as P
from keystrata.streaming.chunks import chunks

PAIRS = [(1, 10), (5, 50), (3, 30), (8, 80)]


def _two(spark, rows=PAIRS):
    return spark.createDataFrame(rows, "c0 bigint, c1 bigint")


def _sorted(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("least, left", [(8, []), (3, [(5, 50), (8, 80)])])
def test_selection(spark, least, left):
    assert _sorted(P.selection(_two(spark), E.gt(F.col("c0"), least))) == left


def test_two_predicates_and_none(spark):
    rows = _two(spark)
    assert _sorted(P.selection(rows, E.gt(F.col("c0"), 2), E.lt(F.col("c1"), 70))) == [(3, 30), (5, 50)]
    assert P.selection(rows).count() == 4


def test_limit(spark):
    rows = _two(spark)
    assert [r.c0 for r in P.limit(rows, 2, "c0", descending=True).collect()] == [8, 5]
    assert P.limit(rows, 0, "c0").count() == 0
    with pytest.raises(ValueError):
        P.limit(rows, -1, "c0")


def test_simple_aggregate(spark):
    defs = {"n": ("count", None), "total": ("sum", "c1"), "mean": ("avg", "c1"), "low": ("min", "c1"), "high": ("max", "c1")}
    assert tuple(P.simple_aggregate(_two(spark, [(1, 10), (2, 20), (3, 30)]), defs).first()) == (3, 60.0, 20.0, 10, 30)
    assert tuple(P.simple_aggregate(_two(spark, []), defs).first()) == (0, None, None, None, None)


def test_hash_aggregate_and_filter_after_it(spark):
    rows = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "a", 30), (4, "b", 40), (5, None, 1), (6, "NULL", 2)], "c0 bigint, c1 string, c2 bigint")
    groups = P.hash_aggregate(rows, ["c1"], {"n": ("count", None), "total": ("sum", "c2")})
    assert {(r.c1, r.n, r.total) for r in groups.collect()} == {("a", 2, 40.0), ("b", 2, 60.0), (None, 1, 1.0), ("NULL", 1, 2.0)}
    assert P.selection(groups, E.gt(F.col("total"), 50)).count() == 1


def test_aggregates_refuse_text(spark):
    rows = spark.createDataFrame([("a",)], "c string")
    for name in ("sum", "avg", "min", "max"):
        with pytest.raises(ValueError):
            P.simple_aggregate(rows, {"x": (name, "c")})
    assert P.simple_aggregate(rows, {"x": ("count", "c")}).first().x == 1


def test_ranges(spark):
    rows = spark.createDataFrame([(k,) for k in "abcdef"], "k string")
    keys = lambda *ranges: sorted(r.k for r in P.table_scan(rows, "k", ranges).collect())
    assert keys(("b", "d")) == ["b", "c"]
    assert keys(("a", "c"), ("b", "d")) == ["a", "b", "b", "c"]
    assert keys((None, "b"), ("e", "")) == ["a", "e", "f"]
    assert keys() == []


def test_run_and_output(spark):
    out = P.run_pipeline(_two(spark), lambda r: P.selection(r, E.gt(F.col("c0"), 2)), lambda r: P.output(r, [1, 0, 9]))
    assert out.columns == ["c1", "c0"] and out.count() == 3
    assert P.output(out).columns == out.columns


def test_decode_row(spark):
    value = (7).to_bytes(8, "big") + (-2).to_bytes(8, "big", signed=True)
    rows = spark.createDataFrame([(b"k", bytearray(value)), (b"s", bytearray(b"short"))], "k binary, v binary")
    got = {bytes(r.k): (r.c2, r.c3) for r in P.decode_row(rows, "k", "v", 2).collect()}
    assert got == {b"k": (7, -2), b"s": (None, None)}


def test_logic_table(spark):
    values = (True, False, None)
    rows = spark.createDataFrame([(a, b) for a in values for b in values], "a boolean, b boolean")
    for r in rows.select("a", "b", E.and_(F.col("a"), F.col("b")).alias("x"), E.or_(F.col("a"), F.col("b")).alias("y"), E.not_(F.col("a")).alias("z")).collect():
        assert r.x is (False if r.a is False or r.b is False else None if None in (r.a, r.b) else True)
        assert r.y is (True if r.a or r.b else None if None in (r.a, r.b) else False)
        assert r.z is (None if r.a is None else not r.a)


def test_arithmetic(spark):
    one = spark.range(1)
    values = one.select(E.div(7, 2).alias("a"), E.div(1, 0).alias("b"), E.plus(1, None).alias("c"), E.mul(3, 4).alias("d"), E.minus(1, 2).alias("e"), E.is_null(None).alias("f")).first()
    assert tuple(values) == (3.5, None, None, 12.0, -1.0, True)
    assert tuple(one.select(E.eq("a", F.lit("b")).alias("x"), E.lt(F.lit(b"a"), b"b").alias("y")).select("y").first()) == (True,)


def test_truthiness(spark):
    row = spark.createDataFrame([(0, 0.5, "", "x", bytearray(b""))], "i int, d double, e string, s string, b binary")
    got = row.select(E.truthy(F.col("i"), "int"), E.truthy(F.col("d"), "double"), E.truthy(F.col("e"), "string"), E.truthy(F.col("s"), "string"), E.truthy(F.col("b"), "binary")).first()
    assert tuple(got) == (False, True, False, True, False)


def test_postfix_errors(spark):
    for nodes in ([("const", 1), ("const", 2)], [("const", 1), ("call", "plus")], []):
        with pytest.raises(ValueError):
            E.from_postfix(nodes, [])
    with pytest.raises(IndexError):
        E.from_postfix([("column", 3)], ["a"])


def test_chunks(spark):
    sizes = [len(c) for c in chunks(spark.range(100), first=8, most=32)]
    assert sizes == [8, 16, 32, 32, 12] and list(chunks(spark.range(0))) == []
