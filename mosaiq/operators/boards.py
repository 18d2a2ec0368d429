"""Masks as bitboards: 32 BIGINTs, one for each row, bit x for column x."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mosaiq.functions.lambdas import indexes, left, let, total
from mosaiq.functions.planes import SIDE

FULL = (1 << SIDE) - 1
INNER = (1 << (SIDE - 1)) - 1


def pack(plane: Column, test) -> Column:
    """The mask of the pixels for which ``test(value)`` holds."""
    bits = lambda row: total(F.transform(row, lambda v, x: F.when(test(v), left(F.lit(1).cast("bigint"), x)).otherwise(F.lit(0).cast("bigint"))))
    return let(plane, lambda p: F.transform(indexes(SIDE), lambda y: bits(F.slice(p, y * SIDE + 1, SIDE))))


def unpack(board: Column) -> Column:
    """0 and 1 in an array of 1024."""
    return F.flatten(F.transform(board, lambda v: F.transform(indexes(SIDE), lambda x: F.call_function("shiftright", v, x).bitwiseAND(F.lit(1).cast("bigint")).cast("int"))))


def at_least(plane: Column, t: float) -> Column:
    return pack(plane, lambda v: v >= t)


def at_most(plane: Column, t: float) -> Column:
    return pack(plane, lambda v: v <= t)


def above(plane: Column, t: float) -> Column:
    """Strictly above: the grammar's threshold."""
    return pack(plane, lambda v: v > F.lit(t).cast("float"))


def gradients(gray: Column, th: int) -> list[Column]:
    """Forward differences dx > th, dx < -th, dy > th, dy < -th; 0 in the last column or row."""

    def step(by: int, inside) -> Column:
        return let(gray, lambda p: F.transform(p, lambda v, i: F.when(inside(i), F.get(p, i + by) - v).otherwise(0)))

    dx = step(1, lambda i: i % SIDE < SIDE - 1)
    dy = step(SIDE, lambda i: i < SIDE * (SIDE - 1))
    return [pack(d, t) for d in (dx, dy) for t in (lambda v: v > th, lambda v: v < -th)]


def sobel(plane: Column, exact: bool, limit: float = 50.0) -> Column:
    """Where the length of the 3 by 3 Sobel gradient, with zeros around, is above ``limit``. ``exact`` compares
    squares of integers; else the length in single precision."""

    def near(p: Column, i: Column, dy: int, dx: int) -> Column:
        x, y = i % SIDE + dx, F.floor(i / SIDE) + dy
        return F.when((x >= 0) & (x < SIDE) & (y >= 0) & (y < SIDE), F.get(p, i + dy * SIDE + dx)).otherwise(F.lit(0))

    def length(p: Column, i: Column) -> Column:
        n = {(dy, dx): near(p, i, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
        gx = (n[-1, 1] - n[-1, -1]) + 2 * (n[0, 1] - n[0, -1]) + (n[1, 1] - n[1, -1])
        gy = (n[1, -1] - n[-1, -1]) + 2 * (n[1, 0] - n[-1, 0]) + (n[1, 1] - n[-1, 1])
        square = gx * gx + gy * gy
        return square if exact else F.sqrt(square.cast("double")).cast("float")

    found = let(plane, lambda p: F.transform(p, lambda v, i: length(p, i)))
    return pack(found, lambda v: v > (limit * limit if exact else limit))
