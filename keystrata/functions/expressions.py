"""The expression functions of push-down pipelines as columns: comparison, logic, arithmetic, null test.

Numbers are compared and combined as doubles, text and bytes by their own order. A null operand
gives null, except where logic decides without it: false and null is false, true or null is true.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Operand = Column | str | int | float | bytes | None


def lit(value: Operand) -> Column:
    """A constant; a column stays as it is."""
    return value if isinstance(value, Column) else F.lit(value)


def _number(value: Operand) -> Column:
    return lit(value).cast("double")


def eq(a: Operand, b: Operand) -> Column:
    return lit(a) == lit(b)


def ne(a: Operand, b: Operand) -> Column:
    return lit(a) != lit(b)


def lt(a: Operand, b: Operand) -> Column:
    return lit(a) < lit(b)


def le(a: Operand, b: Operand) -> Column:
    return lit(a) <= lit(b)


def gt(a: Operand, b: Operand) -> Column:
    return lit(a) > lit(b)


def ge(a: Operand, b: Operand) -> Column:
    return lit(a) >= lit(b)


def and_(a: Column, b: Column) -> Column:
    return a & b


def or_(a: Column, b: Column) -> Column:
    return a | b


def not_(a: Column) -> Column:
    return ~a


def plus(a: Operand, b: Operand) -> Column:
    return _number(a) + _number(b)


def minus(a: Operand, b: Operand) -> Column:
    return _number(a) - _number(b)


def mul(a: Operand, b: Operand) -> Column:
    return _number(a) * _number(b)


def div(a: Operand, b: Operand) -> Column:
    """Quotient as a double; null where the divisor is zero."""
    return F.try_divide(_number(a), _number(b))


def is_null(a: Operand) -> Column:
    return lit(a).isNull()


def as_flag(condition: Column) -> Column:
    """A condition as a value: 1, 0 or null."""
    return condition.cast("bigint")


def truthy(value: Column, kind: str) -> Column:
    """What a filter makes of a value of a Spark type: non-zero, or not empty."""
    if kind == "boolean":
        return value
    return F.length(value) > 0 if kind in ("string", "binary") else value != 0


def all_of(*conditions: Column) -> Column:
    """All conditions hold; true for none."""
    return reduce(and_, conditions, F.lit(True))


FUNCTIONS = {f.__name__.rstrip("_"): f for f in (eq, ne, lt, le, gt, ge, and_, or_, not_, plus, minus, mul, div, is_null)}


def from_postfix(nodes: list[tuple], columns: list[str]) -> Column:
    """A column from postfix nodes: ("column", position), ("const", value) or ("call", function name).

    Raises on an unknown position or function, too few operands, or operands left over.
    """
    stack: list[Column] = []
    for kind, value in nodes:
        if kind == "column":
            stack.append(F.col(f"`{columns[value]}`"))
        elif kind == "const":
            stack.append(F.lit(value))
        else:
            arity = 1 if value in ("not", "is_null") else 2
            if len(stack) < arity:
                raise ValueError(f"{value} lacks operands")
            operands = stack[-arity:]
            del stack[-arity:]
            stack.append(FUNCTIONS[value](*operands))
    if len(stack) != 1:
        raise ValueError(f"the expression leaves {len(stack)} values")
    return stack[0]
