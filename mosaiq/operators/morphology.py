"""Morphology and cellular automata on bitboards: neighbours are shifts, rows above and below are entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mosaiq.functions.lambdas import band, bor, left, let, right
from mosaiq.operators.boards import FULL

_TOP = 1 << 31


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _sides(v: Column, pad: int) -> tuple[Column, Column]:
    """The rows of the left and of the right neighbours; ``pad`` is what lies outside."""
    l, r = left(v, 1).bitwiseAND(_long(FULL)), right(v, 1)
    return (l, r) if not pad else (bor(l, _long(1)), bor(r, _long(_TOP)))


def _rows(board: Column, pad: int, body) -> Column:
    """``body(row, row above, row below)`` for each row."""
    out = _long(FULL if pad else 0)
    return let(board, lambda m: F.transform(m, lambda v, i: body(v, F.coalesce(F.get(m, i - 1), out), F.coalesce(F.get(m, i + 1), out))))


def dilate4(board: Column) -> Column:
    return _rows(board, 0, lambda v, up, down: bor(v, *_sides(v, 0), up, down))


def erode4(board: Column) -> Column:
    """What lies outside counts as set."""
    return _rows(board, 1, lambda v, up, down: band(v, *_sides(v, 1), up, down))


def edge(board: Column) -> Column:
    """Dilation without erosion."""
    return let(board, lambda m: F.zip_with(dilate4(m), erode4(m), lambda a, b: a.bitwiseXOR(b)))


def dilate8(board: Column) -> Column:
    flat = F.transform(board, lambda v: bor(v, *_sides(v, 0)))
    return _rows(flat, 0, lambda v, up, down: bor(v, up, down))


def erode8(board: Column) -> Column:
    """What lies outside counts as not set, so the border always goes."""
    flat = F.transform(board, lambda v: band(v, *_sides(v, 0)))
    return _rows(flat, 0, lambda v, up, down: band(v, up, down))


def neighbours(v: Column, up: Column, down: Column, diagonal: bool) -> Column:
    """The number of set neighbours of each pixel of a row, as four bit planes a (1), b (2), c (4), d (8)."""
    terms = [*_sides(v, 0), up, down]
    if diagonal:
        terms += [*_sides(up, 0), *_sides(down, 0)]
    zero = F.struct(*[_long(0).alias(k) for k in "abcd"])

    def add(acc: Column, t: Column) -> Column:
        one = band(acc["a"], t)
        two = band(acc["b"], one)
        four = band(acc["c"], two)
        return F.struct(acc["a"].bitwiseXOR(t).alias("a"), acc["b"].bitwiseXOR(one).alias("b"), acc["c"].bitwiseXOR(two).alias("c"), acc["d"].bitwiseXOR(four).alias("d"))

    return F.aggregate(F.array(*terms), zero, add)


def _between(n: Column, low: int, high: int) -> Column:
    """Pixels with a count from ``low`` to ``high``."""
    ways = [band(*[n[k] if value >> j & 1 else F.bitwise_not(n[k]) for j, k in enumerate("abcd")]) for value in range(max(low, 0), min(high, 8) + 1)]
    return bor(*ways) if ways else _long(0)


def step(board: Column, birth: tuple[int, int] = (5, 8), survive: tuple[int, int] = (4, 8), diagonal: bool = True) -> Column:
    """One step: a free pixel is born, a set one survives, with so many set neighbours."""

    def row(v: Column, up: Column, down: Column) -> Column:
        def rule(n: Column) -> Column:
            born = band(F.bitwise_not(v), _between(n, *birth))
            return bor(born, band(v, _between(n, *survive))).bitwiseAND(_long(FULL))

        return let(neighbours(v, up, down, diagonal), rule)

    return _rows(board, 0, row)


def run(board: Column, steps: int, **rule) -> list[Column]:
    """The states after 1 to ``steps`` steps, without the first board; none if ``steps`` is not positive."""
    out: list[Column] = []
    for _ in range(steps):
        board = step(board, **rule)
        out.append(board)
    return out


def _times(f, board: Column, n: int) -> Column:
    for _ in range(n):
        board = f(board)
    return board


def life(board: Column) -> Column:
    return step(board, birth=(3, 3), survive=(2, 3))


#: The grammar's rules by name: board and steps to board.
RULES = {
    "life": lambda m, n: _times(life, m, n),
    "erosion": lambda m, n: _times(erode8, m, n),
    "dilation": lambda m, n: _times(dilate8, m, n),
    "opening": lambda m, n: _times(dilate8, _times(erode8, m, n), n),
    "closing": lambda m, n: _times(erode8, _times(dilate8, m, n), n),
}


def automaton(board: Column, steps: int, rule: str) -> Column:
    """A named rule; an unknown name is an error (not, as elsewhere, without effect)."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; known: {', '.join(RULES)}")
    return RULES[rule](board, steps)
