"""The group of the square's symmetries as a graph: its edges, and messages along them over an image's orbit.

An element is 4 * f + k: rotated k times, then mirrored if f is 1. The orbits of ``symmetry`` order it as 2 * k + f."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions.lambdas import let, total


def turned(g: int) -> int:
    """Along the edge of the rotation."""
    return g // 4 * 4 + (g + 1) % 4


def mirrored(g: int) -> int:
    """Along the edge of the reflection."""
    return (4 - g // 4 * 4) + (-g) % 4


def edges(spark: SparkSession) -> DataFrame:
    """(g, step, next): 16 edges."""
    return spark.createDataFrame([(g, step, f(g)) for g in range(8) for step, f in (("r", turned), ("s", mirrored))], "g int, step string, next int")


def by_rotation(orbit: Column) -> Column:
    """An orbit in the order of ``symmetry`` in the order of this graph."""
    return F.array(*[F.get(orbit, g % 4 * 2 + g // 4) for g in range(8)])


def _row(x: Column, weights: Sequence[float]) -> Column:
    return total(F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(0.0))


def layer(orbit: Column, own: Sequence[Sequence[float]], along_r: Sequence[Sequence[float]], along_s: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """One step of messages: max(0, own x[g] + along_r x[turned(g)] + along_s x[mirrored(g)] + bias) for each element; each
    weight has a row for each output. ``orbit``: eight arrays of doubles."""

    def at(o: Column, g: int) -> Column:
        parts = ((F.get(o, g), own), (F.get(o, turned(g)), along_r), (F.get(o, mirrored(g)), along_s))
        return F.array(*[F.greatest(F.lit(0.0), sum((_row(x, w[j]) for x, w in parts), F.lit(float(b)))) for j, b in enumerate(bias)])

    return let(orbit, lambda o: F.array(*[at(o, g) for g in range(8)]))


def pooled(orbit: Column) -> Column:
    """The mean over the group, by position."""
    return let(orbit, lambda o: F.transform(F.get(o, 0), lambda _, j: total(F.transform(o, lambda x: F.get(x, j)), F.lit(0.0)) / F.size(o)))
