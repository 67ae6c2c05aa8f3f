"""Push-down pipelines over line items."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from keystrata.functions import expressions as E
from keystrata.functions.timestamps import compose, logical, physical
from keystrata.operators import pipeline as P
from keystrata.sources.tables import read

COMPARED = {"eq": (E.eq, "="), "lt": (E.lt, "<"), "le": (E.le, "<="), "gt": (E.gt, ">"), "ge": (E.ge, ">="), "ne": (E.ne, "<>")}
KEY = ["l_orderkey", "l_linenumber"]


def _items(spark, sf_dir):
    return read(spark, sf_dir, "lineitem")


def _rounded(rows, **digits):
    return rows.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _flagship(spark, sf_dir):
    rows = P.run_pipeline(
        P.table_scan(_items(spark, sf_dir), "l_orderkey"),
        lambda r: P.selection(r, E.gt(F.col("l_quantity"), 24)),
        lambda r: P.hash_aggregate(r, ["l_returnflag"], {"n": ("count", None), "sum_price": ("sum", "l_extendedprice"), "avg_qty": ("avg", "l_quantity")}),
    )
    return _rounded(rows, sum_price=2, avg_qty=6)


def _compare(op, spark, sf_dir):
    rows = P.selection(_items(spark, sf_dir), op(F.col("l_quantity"), 25), E.le(F.col("l_discount"), 0.05))
    return _rounded(P.hash_aggregate(rows, ["l_linestatus"], {"n": ("count", None), "sum_qty": ("sum", "l_quantity")}), sum_qty=2)


def _logic(spark, sf_dir):
    rows = _items(spark, sf_dir)
    unknown = F.when(F.col("l_quantity") > 10, F.col("l_quantity") > 30)
    other = F.when(F.col("l_discount") > 0.02, F.col("l_discount") > 0.06)
    flags = {"a": unknown, "b": other, "both": E.and_(unknown, other), "either": E.or_(unknown, other)}
    flagged = rows.select(*[E.as_flag(c).alias(n) for n, c in flags.items()])
    return P.hash_aggregate(flagged, list(flags), {"n": ("count", None)})


def _not(spark, sf_dir):
    flag = F.when(F.col("l_quantity") > 10, F.col("l_quantity") > 30)
    rows = _items(spark, sf_dir).select(E.as_flag(flag).alias("a"), E.as_flag(E.not_(flag)).alias("not_a"))
    return P.hash_aggregate(rows, ["a", "not_a"], {"n": ("count", None)})


def _is_null(spark, sf_dir):
    rows = _items(spark, sf_dir).select(E.as_flag(E.is_null(F.when(F.col("l_quantity") > 10, F.col("l_quantity")))).alias("absent"))
    return P.hash_aggregate(rows, ["absent"], {"n": ("count", None)})


def _arithmetic(spark, sf_dir):
    price, cut = F.col("l_extendedprice"), F.col("l_discount")
    value = E.minus(E.plus(E.mul(price, E.minus(1, cut)), F.col("l_tax")), F.col("l_quantity"))
    rows = _items(spark, sf_dir).select("l_returnflag", value.alias("v"))
    return _rounded(P.hash_aggregate(rows, ["l_returnflag"], {"total": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v")}), total=1, low=4, high=4)


def _division(spark, sf_dir):
    rows = _items(spark, sf_dir).select("l_linenumber", E.div(F.col("l_quantity"), F.col("l_discount")).alias("q"))
    return _rounded(P.hash_aggregate(rows, ["l_linenumber"], {"n": ("count", None), "n_defined": ("count", "q"), "total": ("sum", "q")}), total=1)


def _aggregates(defs, digits, spark, sf_dir):
    return _rounded(P.simple_aggregate(_items(spark, sf_dir), defs), **digits)


def _empty(grouped, spark, sf_dir):
    rows = P.selection(_items(spark, sf_dir), E.lt(F.col("l_quantity"), 0))
    defs = {"n": ("count", None), "n_qty": ("count", "l_quantity"), "total": ("sum", "l_quantity"), "mean": ("avg", "l_quantity"), "low": ("min", "l_quantity")}
    return P.hash_aggregate(rows, ["l_returnflag"], defs) if grouped else P.simple_aggregate(rows, defs)


def _having(spark, sf_dir):
    rows = P.hash_aggregate(_items(spark, sf_dir), ["l_suppkey"], {"n": ("count", None), "total": ("sum", "l_quantity")})
    return _rounded(P.selection(rows, E.gt(F.col("total"), 1500)), total=2)


def _limit(descending, spark, sf_dir):
    rows = P.selection(_items(spark, sf_dir), E.gt(F.col("l_quantity"), 45))
    return P.limit(rows, 100, KEY, descending).select(*KEY, "l_quantity")


def _ranges(spark, sf_dir):
    rows = P.table_scan(_items(spark, sf_dir), "l_orderkey", [(100, 300), (200, 500), (1000, None)])
    return P.hash_aggregate(rows, ["l_returnflag"], {"n": ("count", None)})


def _disjoint(spark, sf_dir):
    rows = P.table_scan(_items(spark, sf_dir), "l_orderkey", [(None, 100), (500, 900)])
    return P.hash_aggregate(rows, ["l_orderkey"], {"n": ("count", None)})


def _offsets(spark, sf_dir):
    rows = _items(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return P.output(rows, [3, 0, 99])


def _postfix(spark, sf_dir):
    rows = _items(spark, sf_dir)
    nodes = [("column", rows.columns.index("l_quantity")), ("const", 10), ("call", "mul"), ("column", rows.columns.index("l_tax")), ("const", 0), ("call", "gt"), ("call", "is_null"), ("call", "not")]
    value, test = E.from_postfix(nodes[:3], rows.columns), E.from_postfix(nodes[3:], rows.columns)
    kept = P.selection(rows, test).select(value.alias("v"))
    return _rounded(P.simple_aggregate(kept, {"n": ("count", None), "total": ("sum", "v")}), total=1)


def _hybrid_time(spark, sf_dir):
    ts = compose(F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id") % 262144)
    return read(spark, sf_dir, "events").select("event_id", ts.alias("hybrid"), physical(ts).alias("ms"), logical(ts).alias("counter"))


_ONE = {
    "count_star": ({"n": ("count", None)}, {}, "count(*) AS n"),
    "count_col": ({"n": ("count", "l_shipdate")}, {}, "count(l_shipdate) AS n"),
    "sum": ({"total": ("sum", "l_extendedprice")}, {"total": 1}, "round(sum(l_extendedprice), 1) AS total"),
    "avg": ({"mean": ("avg", "l_extendedprice")}, {"mean": 4}, "round(avg(l_extendedprice), 4) AS mean"),
    "min_max": ({"low": ("min", "l_extendedprice"), "high": ("max", "l_extendedprice")}, {}, "min(l_extendedprice) AS low, max(l_extendedprice) AS high"),
}
_A, _B = "CASE WHEN l_quantity > 10 THEN l_quantity > 30 END", "CASE WHEN l_discount > 0.02 THEN l_discount > 0.06 END"
_VALUE = "l_extendedprice * (1 - l_discount) + l_tax - l_quantity"
_EMPTY = "count(*) AS n, count(l_quantity) AS n_qty, sum(l_quantity) AS total, avg(l_quantity) AS mean, min(l_quantity) AS low FROM lineitem WHERE l_quantity < 0"

QUERIES = {
    "cop_scan_filter_group_sum": (_flagship, "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_quantity), 6) AS avg_qty FROM lineitem WHERE l_quantity > 24 GROUP BY l_returnflag"),
    **{
        f"cop_selection_{name}": (partial(_compare, op), f"SELECT l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty FROM lineitem WHERE l_quantity {sign} 25 AND l_discount <= 0.05 GROUP BY l_linestatus")
        for name, (op, sign) in COMPARED.items()
    },
    "cop_logic_3vl": (_logic, f"SELECT a::BIGINT AS a, b::BIGINT AS b, (a AND b)::BIGINT AS both, (a OR b)::BIGINT AS either, count(*) AS n FROM (SELECT {_A} AS a, {_B} AS b FROM lineitem) GROUP BY ALL"),
    "cop_not": (_not, f"SELECT a::BIGINT AS a, (NOT a)::BIGINT AS not_a, count(*) AS n FROM (SELECT {_A} AS a FROM lineitem) GROUP BY ALL"),
    "cop_isnull": (_is_null, "SELECT (CASE WHEN l_quantity > 10 THEN l_quantity END IS NULL)::BIGINT AS absent, count(*) AS n FROM lineitem GROUP BY ALL"),
    "cop_arith": (_arithmetic, f"SELECT l_returnflag, round(sum({_VALUE}), 1) AS total, round(min({_VALUE}), 4) AS low, round(max({_VALUE}), 4) AS high FROM lineitem GROUP BY l_returnflag"),
    "cop_div_by_zero": (_division, "SELECT l_linenumber, count(*) AS n, count(q) AS n_defined, round(sum(q), 1) AS total FROM (SELECT l_linenumber, CASE WHEN l_discount <> 0 THEN l_quantity / l_discount END AS q FROM lineitem) GROUP BY l_linenumber"),
    **{f"cop_{name}": (partial(_aggregates, defs, digits), f"SELECT {sql} FROM lineitem") for name, (defs, digits, sql) in _ONE.items()},
    "cop_simple_aggr_empty": (partial(_empty, False), f"SELECT {_EMPTY}"),
    "cop_hash_aggr_empty": (partial(_empty, True), f"SELECT l_returnflag, {_EMPTY} GROUP BY l_returnflag"),
    "cop_having": (_having, "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 1500"),
    "cop_limit_asc": (partial(_limit, False), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 ORDER BY 1, 2 LIMIT 100"),
    "cop_limit_desc": (partial(_limit, True), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 ORDER BY 1 DESC, 2 DESC LIMIT 100"),
    "cop_multi_range": (
        _ranges,
        "SELECT l_returnflag, count(*) AS n FROM (SELECT l_returnflag FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 300 UNION ALL SELECT l_returnflag FROM lineitem WHERE l_orderkey >= 200 AND l_orderkey < 500 UNION ALL SELECT l_returnflag FROM lineitem WHERE l_orderkey >= 1000) GROUP BY l_returnflag",
    ),
    "cop_disjoint_ranges": (_disjoint, "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey < 100 OR l_orderkey >= 500 AND l_orderkey < 900 GROUP BY l_orderkey"),
    "cop_output_offsets": (_offsets, "SELECT l_linenumber, l_orderkey FROM lineitem"),
    "cop_postfix_expression": (_postfix, "SELECT count(*) AS n, round(sum(l_quantity * 10), 1) AS total FROM lineitem WHERE (l_tax > 0) IS NOT NULL"),
    "ts_compose_split": (_hybrid_time, "SELECT event_id, (ms << 18) | (event_id % 262144) AS hybrid, ms, event_id % 262144 AS counter FROM (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events)"),
}
