"""Geometry of chords as column expressions; points are (y, x), divisions by zero give null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(ay: Column, ax: Column, by: Column, bx: Column) -> Column:
    return F.sqrt((ay - by) * (ay - by) + (ax - bx) * (ax - bx))


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def unit(y: Column, x: Column) -> tuple[Column, Column]:
    """The unit vector; null for a zero vector."""
    length = F.sqrt(y * y + x * x)
    return safe_divide(y, length), safe_divide(x, length)


def quarter_turn(y: Column, x: Column) -> tuple[Column, Column]:
    """The normal of a vector: (x, -y)."""
    return x, -y


def midpoint(a: Column, b: Column) -> Column:
    return (a + b) / 2


def turned_area(ly: Column, lx: Column, ry: Column, rx: Column, ty: Column, tx: Column) -> Column:
    """Twice the signed area of left, right and third point."""
    return (rx - lx) * (ly - ty) - (lx - tx) * (ry - ly)


def angle(dy: Column, dx: Column) -> Column:
    return F.atan2(dy, dx)


def signed_angle(dy: Column, dx: Column) -> Column:
    """``angle`` that goes by the signs of zeros, which Spark's atan2 drops: (-0.0, -1.0) is -pi, and (0.0, -0.0) is pi."""
    minus = lambda v: (v < 0) | (F.pow(v, F.lit(-1.0)) < 0)
    flat = F.when(minus(dx), F.lit(math.pi)).otherwise(0.0) * F.when(minus(dy), -1.0).otherwise(1.0)
    return F.when((dy == 0) & ~F.isnan(dx), flat).otherwise(angle(dy, dx))


def palette(number: Column) -> tuple[Column, Column, Column]:
    """A colour for a number, three values of 0 to 1."""
    return tuple((number.cast("long") * factor % 255) / 255.0 for factor in ((1 << 25) - 1, (1 << 15) - 1, (1 << 21) - 1))


def rounded(value: Column, places: int) -> Column:
    """``value`` rounded half away from zero on its binary product with a power of ten, as the SQL twins' engine does it.

    What rounds to zero from below is -0.0; Spark's own rounding goes by decimals and loses the sign.
    """
    scaled = F.abs(value) * float(10**places)
    even = F.rint(scaled)
    return F.when(F.abs(value) == float("inf"), value).otherwise(F.when(scaled - even == 0.5, even + 1).otherwise(even) / float(10**places) * F.signum(value))
