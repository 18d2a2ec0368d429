"""Small helpers around Spark's higher-order array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def indexes(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def total(values: Column, zero: Column | None = None) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint") if zero is None else zero, lambda a, v: a + v)


def left(value: Column, by: Column | int) -> Column:
    return F.call_function("shiftleft", value, by if isinstance(by, Column) else F.lit(by))


def right(value: Column, by: Column | int) -> Column:
    return F.call_function("shiftright", value, by if isinstance(by, Column) else F.lit(by))


def band(*values: Column) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out.bitwiseAND(v)
    return out


def bor(*values: Column) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out.bitwiseOR(v)
    return out


def histogram(codes: Column, n: int) -> Column:
    """How often each of 0 to n - 1 occurs in an array of codes. More than 32 codes are first split by their
    high part, so that each is looked at about 2 * sqrt(n) times."""
    if n <= 32:
        return let(codes, lambda c: F.transform(indexes(n), lambda k: F.size(F.filter(c, lambda v: v == k))))
    low = 1 << ((n - 1).bit_length() // 2)
    parts = -(-n // low)
    full = let(codes, lambda c: F.flatten(F.transform(indexes(parts), lambda h: let(F.filter(c, lambda v: F.floor(v / low) == h), lambda own: F.transform(indexes(low), lambda k: F.size(F.filter(own, lambda v: v % low == k)))))))
    return full if parts * low == n else F.slice(full, 1, n)
