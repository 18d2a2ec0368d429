"""Table functions for SQL: ``SELECT ... FROM images, LATERAL d4_orbit(r, g, b)`` and ``LATERAL automaton_states(m, 3)``.

They are made of the same definitions as the columns of ``operators``; rows come out of one task's work, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from mosaiq.functions.planes import SIDE
from mosaiq.operators.symmetry import ELEMENTS, source_index


def _bits(rows: list[int]) -> np.ndarray:
    return (np.array(rows, np.int64)[:, None] >> np.arange(SIDE)) & 1


def _rows(bits: np.ndarray) -> list[int]:
    return (bits.astype(np.int64) << np.arange(SIDE)).sum(axis=1).tolist()


@udtf(returnType="element int, r array<int>, g array<int>, b array<int>")
class D4Orbit:
    """An image's eight forms, in the order of ``symmetry.orbit``. A null plane gives no rows."""

    def __init__(self) -> None:
        self.maps = [np.array([source_index(e, i) for i in range(SIDE * SIDE)]) for e in range(len(ELEMENTS))]

    def eval(self, r: list[int], g: list[int], b: list[int]) -> Iterator[tuple]:
        if r is None or g is None or b is None:
            return
        planes = [np.asarray(p) for p in (r, g, b)]
        for e, at in enumerate(self.maps):
            yield (e, *[p[at].tolist() for p in planes])


@udtf(returnType="step int, m array<bigint>")
class AutomatonStates:
    """A mask after 1, 2, ... ``steps`` steps: a free pixel is born, a set one survives, with so many set neighbours. A null mask, or no step,
    gives no rows."""

    def eval(self, m: list[int], steps: int, birth_min: int = 5, birth_max: int = 8, survive_min: int = 4, survive_max: int = 8, diagonal: bool = True) -> Iterator[tuple]:
        if m is None or steps is None:
            return
        bits = _bits(m)
        for step in range(1, steps + 1):
            wide = np.pad(bits, 1)
            around = [(0, 1), (2, 1), (1, 0), (1, 2)] + ([(0, 0), (0, 2), (2, 0), (2, 2)] if diagonal else [])
            n = sum(wide[y : y + SIDE, x : x + SIDE] for y, x in around)
            born, stays = (n >= birth_min) & (n <= birth_max), (n >= survive_min) & (n <= survive_max)
            bits = np.where(bits == 1, stays, born).astype(np.int64)
            yield step, _rows(bits)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    spark.udtf.register("d4_orbit", D4Orbit)
    spark.udtf.register("automaton_states", AutomatonStates)
