"""Pixel planes: arrays of 1024 values, row by row, from the colour planes of an image of 32 by 32.

Two families with the same names and other rules: integers (counts) and ``g_`` (the grammar's single precision)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mosaiq.functions.lambdas import right

SIDE = 32


def gray_u8(r: Column, g: Column, b: Column) -> Column:
    """(77 r + 150 g + 29 b) >> 8"""
    return F.zip_with(F.zip_with(r, g, lambda x, y: 77 * x + 150 * y), b, lambda s, z: right(s + 29 * z, 8))


def opponent_rg(r: Column, g: Column) -> Column:
    return F.zip_with(r, g, lambda x, y: x - y)


def opponent_yb2(r: Column, g: Column, b: Column) -> Column:
    """2 b - r - g: positive for blue, twice the scale of ``g_opponent_yb``."""
    return F.zip_with(F.zip_with(r, g, lambda x, y: x + y), b, lambda s, z: 2 * z - s)


def saturation(r: Column, g: Column, b: Column) -> Column:
    high = F.zip_with(F.zip_with(r, g, lambda x, y: F.greatest(x, y)), b, lambda x, y: F.greatest(x, y))
    low = F.zip_with(F.zip_with(r, g, lambda x, y: F.least(x, y)), b, lambda x, y: F.least(x, y))
    return F.zip_with(high, low, lambda x, y: x - y)


def clip_i16(values: Column) -> Column:
    return F.transform(values, lambda v: F.greatest(F.lit(-32768), F.least(F.lit(32767), v)).cast("smallint"))


def _f(x: float) -> Column:
    return F.lit(x).cast("float")


def g_plane(p: Column) -> Column:
    return F.transform(p, lambda v: v.cast("float"))


def g_gray(r: Column, g: Column, b: Column) -> Column:
    """0.299 r + 0.587 g + 0.114 b, added from the left in single precision."""
    rg = F.zip_with(r, g, lambda x, y: _f(0.299) * x.cast("float") + _f(0.587) * y.cast("float"))
    return F.zip_with(rg, b, lambda s, z: s + _f(0.114) * z.cast("float"))


def g_gray_double(r: Column, g: Column, b: Column) -> Column:
    """The same in double precision, rounded to single at the end."""
    rg = F.zip_with(r, g, lambda x, y: F.lit(0.299) * x + F.lit(0.587) * y)
    return F.zip_with(rg, b, lambda s, z: (s + F.lit(0.114) * z).cast("float"))


def g_opponent_rg(r: Column, g: Column) -> Column:
    return F.zip_with(r, g, lambda x, y: (x - y).cast("float"))


def g_opponent_yb(r: Column, g: Column, b: Column) -> Column:
    """(r + g) / 2 - b: the other sign and half the scale of ``opponent_yb2``."""
    rg = F.zip_with(r, g, lambda x, y: ((x + y) / 2).cast("float"))
    return F.zip_with(rg, b, lambda s, z: s - z.cast("float"))


def g_saturation(r: Column, g: Column, b: Column) -> Column:
    """(max - min) / (max + 1e-9) from 0 to 1; 0 for black."""
    high = F.zip_with(F.zip_with(r, g, lambda x, y: F.greatest(x, y)), b, lambda x, y: F.greatest(x, y))
    low = F.zip_with(F.zip_with(r, g, lambda x, y: F.least(x, y)), b, lambda x, y: F.least(x, y))
    return F.zip_with(high, low, lambda x, y: F.when(x > 0, (x - y).cast("float") / (x.cast("float") + _f(1e-9))).otherwise(_f(0.0)).cast("float"))


#: Channel by name in either family.
INT = {"gray": gray_u8, "yb": opponent_yb2, "sat": saturation}
