"""Order-preserving key encodings as columns: encoded bytes sort as the values do."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

#: Fixed by the format: bytes of a group, and the marker of a full one.
GROUP, FULL = 8, 0xFF
#: Hexadecimal digits of a group.
_DIGITS = 2 * GROUP
#: The sign bit of a bigint.
SIGN = -(1 << 63)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for a row.

    Lambdas also keep the columns beside them out of one long generated method, which the JVM wouldn't compile.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _long(value: int) -> Column:
    return F.lit(str(value)).cast("bigint")


def _hex16(value: Column) -> Column:
    return F.lpad(F.hex(value), 16, "0")


def _inverted(binary: Column) -> Column:
    """Every bit flipped, by translating hexadecimal digits."""
    return F.unhex(F.translate(F.hex(binary), "0123456789ABCDEF", "FEDCBA9876543210"))


def encode_int64(value: Column) -> Column:
    """Eight bytes, big-endian, with the sign bit flipped."""
    return F.unhex(_hex16(value.cast("bigint").bitwiseXOR(_long(SIGN))))


def encode_int64_desc(value: Column) -> Column:
    return _inverted(encode_int64(value))


def decode_int64(binary: Column) -> Column:
    """Inverse of encode_int64; null unless there are eight bytes."""
    return F.when(F.octet_length(binary) == 8, F.conv(F.hex(binary), 16, -10).cast("bigint").bitwiseXOR(_long(SIGN)))


def decode_int64_desc(binary: Column) -> Column:
    return decode_int64(_inverted(binary))


def encode_uint64(value: Column) -> Column:
    """Eight bytes, big-endian, of a number below 2^64 (bigint or decimal(20,0))."""
    return F.unhex(F.lpad(F.conv(value.cast("string"), 10, 16), 16, "0"))


def decode_uint64(binary: Column) -> Column:
    return F.when(F.octet_length(binary) == 8, F.conv(F.hex(binary), 16, 10).cast("decimal(20,0)"))


def encode_bytes(binary: Column) -> Column:
    """Groups of eight bytes, padded with zeros, each followed by 0xFF less its padding.

    A full last group is followed by an empty one, so that no encoding is a prefix of another.
    """

    def marked(digits: Column) -> Column:
        size = (F.length(digits) / 2).cast("int")
        before = F.floor(size / GROUP).cast("int") * _DIGITS  # digits of full groups
        full = F.when(size >= GROUP, F.regexp_replace(F.substring(digits, F.lit(1), before), f"(.{{{_DIGITS}}})", f"$1{FULL:X}")).otherwise("")
        rest = F.rpad(F.substring(digits, before + 1, F.lit(_DIGITS)), _DIGITS, "0")
        return F.unhex(F.concat(full, rest, F.hex((size % GROUP + FULL - GROUP).cast("bigint"))))

    return _let(F.hex(binary), marked)


def decode_bytes(binary: Column) -> Column:
    """Inverse of encode_bytes; null for what it can't have produced."""
    digits, size = F.hex(binary), F.octet_length(binary)
    joined = F.when(size > GROUP + 1, F.regexp_replace(digits, f"\\G(.{{{_DIGITS}}}){FULL:X}", "$1")).otherwise(digits)  # the last marker stays
    before = (F.floor(size / (GROUP + 1)).cast("int") - 1) * _DIGITS
    kept = F.position(F.substring(digits, -1, 1), F.lit("789ABCDE")) - 1  # bytes of the last group
    padding = F.substring(joined, before + 2 * kept + 1, _DIGITS - 2 * kept)
    marked = (F.length(joined) == before + _DIGITS + 2) & (F.substring(digits, -2, 1) == "F") & (kept >= 0) & (F.translate(padding, "0", "") == "")
    return F.when((size > 0) & (size % (GROUP + 1) == 0) & marked, F.unhex(F.substring(joined, F.lit(1), before + 2 * kept)))


def encode_bytes_desc(binary: Column) -> Column:
    return _inverted(encode_bytes(binary))


def decode_bytes_desc(binary: Column) -> Column:
    return decode_bytes(_inverted(binary))


@F.arrow_udf(LongType())
def _bits(doubles: pa.Array) -> pa.Array:
    """IEEE 754 bits; zeros have no sign here, and there is one NaN, which sorts last."""
    return pc.if_else(pc.is_nan(doubles), float("nan"), pc.add(doubles, 0.0)).view(pa.int64())


@F.arrow_udf(DoubleType())
def _of_bits(bits: pa.Array) -> pa.Array:
    return bits.view(pa.float64())


def encode_float64(value: Column) -> Column:
    """Eight bytes that sort as doubles do: all bits flipped below zero, else the sign bit."""
    bits = _bits(value.cast("double"))
    return F.unhex(_hex16(bits.bitwiseXOR(F.shiftright(bits, 63).bitwiseOR(_long(SIGN)))))


def decode_float64(binary: Column) -> Column:
    """Inverse of encode_float64; null unless there are eight bytes."""
    number = decode_int64(binary)  # the sign bit is flipped back
    return _of_bits(number.bitwiseXOR(F.shiftright(number, 63).bitwiseAND(_long(~SIGN))))


def encode_uvarint(value: Column) -> Column:
    """Seven bits a byte from the lowest on, each byte but the last with its high bit set, of a bigint read as unsigned."""
    part = lambda i: F.shiftrightunsigned(value.cast("bigint"), 7 * i)
    groups = [F.when(F.lit(i == 0) | (part(i) != 0), F.lpad(F.hex(part(i).bitwiseAND(F.lit(127)) + F.when(part(i + 1) != 0, 128).otherwise(0) if i < 9 else part(i).bitwiseAND(F.lit(1))), 2, "0")).otherwise("") for i in range(10)]
    return F.unhex(F.concat(*groups))


def decode_uvarint(binary: Column) -> Column:
    """Inverse of encode_uvarint; null unless the bytes are one whole number of 64 bits."""
    size = F.octet_length(binary)
    number = lambda start, n: F.conv(F.rpad(F.hex(F.substring(binary, start, n)), 2 * n, "0"), 16, -10).cast("bigint")
    head, tail = number(1, 8), number(9, 2)
    byte = lambda i: F.shiftrightunsigned(head, 56 - 8 * i) if i < 8 else F.shiftrightunsigned(tail, 72 - 8 * i)  # noqa: E731 - and what stands before it
    total, more = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for i in range(10):
        total = total.bitwiseOR(F.shiftleft(byte(i).bitwiseAND(_long(127)), 7 * i))
        more = more.bitwiseOR(F.shiftleft(F.shiftright(byte(i), 7).bitwiseAND(_long(1)), i))
    whole = (size > 0) & (size <= 10) & (more + 1 == F.pow(F.lit(2.0), size - 1))
    return F.when(whole & ((size < 10) | (byte(9).bitwiseAND(_long(255)) < 2)), total)


def encode_varint(value: Column) -> Column:
    """Zigzag, so that small numbers of either sign are short, then as encode_uvarint."""
    number = value.cast("bigint")
    return encode_uvarint(F.shiftleft(number, 1).bitwiseXOR(F.shiftright(number, 63)))


def decode_varint(binary: Column) -> Column:
    """Inverse of encode_varint."""
    coded = decode_uvarint(binary)
    return F.shiftrightunsigned(coded, 1).bitwiseXOR(-coded.bitwiseAND(F.lit(1).cast("bigint")))
