"""The five aggregate functions of push-down pipelines; nulls are skipped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types whose sum, average, minimum and maximum are defined.
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def count_all() -> Column:
    return F.count(F.lit(1))


def count(column: str) -> Column:
    return F.count(column)


def total(column: str) -> Column:
    """Sum as a double; null without values."""
    return F.sum(F.col(column).cast("double"))


def average(column: str) -> Column:
    return F.avg(column)


def least(column: str) -> Column:
    return F.min(column)


def greatest(column: str) -> Column:
    return F.max(column)


AGGREGATES = {"count": count, "sum": total, "avg": average, "min": least, "max": greatest}


def aggregate(name: str, column: str | None, kind: str | None) -> Column:
    """An aggregate by name; count without a column counts rows. All but count need a number."""
    if column is None:
        if name != "count":
            raise ValueError(f"{name} needs a column")
        return count_all()
    if name != "count" and not str(kind).startswith(NUMERIC):
        raise ValueError(f"{name}({column}) needs a number, not {kind}")
    return AGGREGATES[name](column)
