"""Push-down pipelines: scan of key ranges, selection, limit, aggregation, output columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions.aggregates import aggregate
from keystrata.functions.expressions import all_of

Bound = str | int | bytes | None
Step = Callable[[DataFrame], DataFrame]


def in_range(key: Column, start: Bound, end: Bound) -> Column:
    """start <= key < end; an absent or empty bound is open."""
    bounds = [key >= F.lit(start)] if start not in (None, "", b"") else []
    return all_of(*bounds, *([key < F.lit(end)] if end not in (None, "", b"") else []))


def table_scan(table: DataFrame, key: str, ranges: Sequence[tuple[Bound, Bound]] = ((None, None),)) -> DataFrame:
    """Rows of the given half-open key ranges.

    Overlapping ranges give a row once for each range. Disjoint ranges are one scan with a
    disjunction, which reaches the files' statistics.
    """
    if not ranges:
        return table.limit(0)
    known = sorted(ranges, key=lambda r: (r[0] not in (None, "", b""), r[0] or ""))
    apart = all(a[1] not in (None, "", b"") and b[0] not in (None, "", b"") and a[1] <= b[0] for a, b in zip(known, known[1:], strict=False))
    if apart:
        return table.filter(reduce(lambda a, b: a | b, [in_range(F.col(key), *r) for r in ranges]))
    return reduce(DataFrame.unionAll, [table.filter(in_range(F.col(key), *r)) for r in ranges])


def selection(rows: DataFrame, *predicates: Column) -> DataFrame:
    """Rows for which all predicates are true; null drops a row, no predicate keeps all."""
    return reduce(DataFrame.filter, predicates, rows)


def limit(rows: DataFrame, n: int, key: str | Sequence[str], descending: bool = False) -> DataFrame:
    """The first n rows in key order; n = 0 gives none, a negative n is refused."""
    if n < 0:
        raise ValueError("a limit can't be negative")
    keys = [key] if isinstance(key, str) else list(key)
    return rows.orderBy(*[F.desc(k) if descending else F.asc(k) for k in keys]).limit(n)


def _columns(rows: DataFrame, aggregates: dict[str, tuple[str, str | None]]) -> list[Column]:
    kinds = dict(rows.dtypes)
    return [aggregate(name, column, kinds.get(column or "")).alias(out) for out, (name, column) in aggregates.items()]


def simple_aggregate(rows: DataFrame, aggregates: dict[str, tuple[str, str | None]]) -> DataFrame:
    """One row with the aggregates {output: (function, column)}, also for no rows."""
    return rows.agg(*_columns(rows, aggregates))


def hash_aggregate(rows: DataFrame, by: Sequence[str], aggregates: dict[str, tuple[str, str | None]]) -> DataFrame:
    """A row for each group; nulls are a group; no rows give no groups."""
    return rows.groupBy(*by).agg(*_columns(rows, aggregates))


def output(rows: DataFrame, offsets: Sequence[int] = ()) -> DataFrame:
    """Columns by position, in the given order; none means all; positions out of range are skipped."""
    return rows.select([rows.columns[i] for i in offsets if 0 <= i < len(rows.columns)]) if offsets else rows


def run_pipeline(scan: DataFrame, *steps: Step) -> DataFrame:
    """Apply steps to a scan in order; a selection after an aggregation filters groups."""
    return reduce(lambda rows, step: step(rows), steps, scan)


def decode_row(table: DataFrame, key: str, value: str, integers: int) -> DataFrame:
    """Key, value and the value's leading big-endian 64-bit integers c2, c3, ...; null where it is too short."""
    raw = lambda i: F.conv(F.hex(F.substring(value, 8 * i + 1, 8)), 16, -10).cast("bigint")
    whole = F.octet_length(value) >= 8 * integers
    return table.select(key, value, *[F.when(whole, raw(i)).alias(f"c{i + 2}") for i in range(integers)])
