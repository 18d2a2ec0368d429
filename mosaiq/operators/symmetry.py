"""The eight symmetries of the square: index maps, orbits, pooling over an orbit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.lambdas import let, total
from mosaiq.functions.planes import SIDE

#: Order of an orbit: rotations by 0, 90, 180 and 270 degrees, each followed by its mirror image.
ELEMENTS = tuple((k, s) for k in range(4) for s in (0, 1))


def source_index(element: int, i: int) -> int:
    """Where pixel ``i`` of the transformed plane comes from: mirrored after it was rotated."""
    k, s = ELEMENTS[element]
    y, x = divmod(i, SIDE)
    x = SIDE - 1 - x if s else x
    last = SIDE - 1
    y, x = ((y, x), (x, last - y), (last - y, last - x), (last - x, y))[k]
    return y * SIDE + x


def moved(plane: Column, element: int) -> Column:
    k, s = ELEMENTS[element]

    def take(p: Column, i: Column) -> Column:
        y, x = F.floor(i / SIDE).cast("int"), i % SIDE
        x = SIDE - 1 - x if s else x
        last = SIDE - 1
        y, x = ((y, x), (x, last - y), (last - y, last - x), (last - x, y))[k]
        return F.get(p, y * SIDE + x)

    return plane if element == 0 else let(plane, lambda p: F.transform(p, lambda _, i: take(p, i)))


def flip_x(plane: Column) -> Column:
    return moved(plane, 1)


def orbit(images: DataFrame) -> DataFrame:
    """Eight rows for each image, with ``g`` from 0 to 7, without a shuffle."""
    all8 = F.array(*[F.struct(*[moved(F.col(c), e).alias(c) for c in "rgb"]) for e in range(8)])
    return images.select(*[c for c in images.columns if c not in ("r", "g", "b")], F.posexplode(all8).alias("g_", "v")).select(*[c for c in images.columns if c not in ("r", "g", "b")], F.col("g_").alias("g"), "v.r", F.col("v.g").alias("green"), "v.b").withColumnRenamed("g", "element").withColumnRenamed("green", "g")


def pool(vectors: Column, how: str = "mean") -> Column:
    """Pools eight integer vectors by position within the row; halves are rounded to even."""

    def of(values: Column) -> Column:
        if how == "mean":
            return F.bround(total(F.transform(values, lambda v: v.cast("bigint"))) / F.size(values))
        if how == "max":
            return F.array_max(values)
        return let(F.array_sort(values), lambda s: F.bround((F.get(s, 3) + F.get(s, 4)) / F.lit(2.0)))

    if how not in ("mean", "max", "median"):
        raise ValueError(f"unknown pooling {how!r}: mean, max or median")
    return let(vectors, lambda v: F.transform(F.get(v, 0), lambda _, i: of(F.transform(v, lambda x: F.get(x, i))).cast("int")))
