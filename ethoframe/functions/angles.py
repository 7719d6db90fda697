"""Angles and planar vectors as column expressions. Angles are in degrees unless radians is set."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _full(radians: bool) -> float:
    return 2 * math.pi if radians else 360.0


def normalize_angle(angle: Column, radians: bool = False) -> Column:
    """The angle in [-half turn, half turn): both +180 and -180 give -180."""
    full = _full(radians)
    return F.pmod(angle + full / 2, F.lit(full)) - full / 2


def angle_sign(angle: Column, radians: bool = False) -> Column:
    """-1 where the angle lies in [-half turn, 0], 1 where in (0, half turn)."""
    return F.when(normalize_angle(angle, radians) <= 0, F.lit(-1)).otherwise(F.lit(1))


def delta_angle(minuend: Column, subtrahend: Column, radians: bool = False) -> Column:
    """The signed shortest way from subtrahend to minuend."""
    return normalize_angle(minuend - subtrahend, radians)


def polar(x: Column, y: Column) -> Column:
    """struct(rho, phi) of a point; phi in radians."""
    return F.struct(F.hypot(x, y).alias("rho"), F.atan2(y, x).alias("phi"))


def cartesian(rho: Column, phi: Column) -> Column:
    """struct(x, y) of polar coordinates; phi in radians."""
    return F.struct((rho * F.cos(phi)).alias("x"), (rho * F.sin(phi)).alias("y"))


def rotate(x: Column, y: Column, angle: Column, origin_x: Column | None = None, origin_y: Column | None = None) -> Column:
    """struct(x, y) of the point turned by angle (radians) around the origin given."""
    ox, oy = origin_x if origin_x is not None else F.lit(0.0), origin_y if origin_y is not None else F.lit(0.0)
    dx, dy = x - ox, y - oy
    return F.struct((dx * F.cos(angle) - dy * F.sin(angle) + ox).alias("x"), (dx * F.sin(angle) + dy * F.cos(angle) + oy).alias("y"))


def affine(x: Column, y: Column, matrix: list[list[float]]) -> Column:
    """struct(x, y) of a 2 x 3 affine matrix applied to (x, y, 1)."""
    (a, b, c), (d, e, f) = matrix[0], matrix[1]
    return F.struct((x * a + y * b + c).alias("x"), (x * d + y * e + f).alias("y"))


def row_transform(x: Column, y: Column, matrix: list[list[float]]) -> Column:
    """struct(x, y) of the row vector (x, y) times the first two rows, plus the last row."""
    (a, b), (c, d) = matrix[0], matrix[1]
    p, q = matrix[-1]
    return F.struct((x * a + y * c + p).alias("x"), (x * b + y * d + q).alias("y"))


def inverted_affine(matrix: list[list[float]]) -> list[list[float]]:
    """The 2 x 3 matrix that undoes a 2 x 3 affine matrix."""
    (a, b, c), (d, e, f) = matrix[0], matrix[1]
    det = a * e - b * d
    if not det:
        raise ValueError("the transform has no inverse")
    return [[e / det, -b / det, (b * f - e * c) / det], [-d / det, a / det, (d * c - a * f) / det]]


def linear_zero(a: Column, b: Column) -> Column:
    """x with a * x + b = 0; an error where a is 0."""
    return F.when(a == 0, F.raise_error(F.lit("a line without slope has no zero"))).otherwise(F.try_divide(-b, a))


def inverse_linear(slope: Column, intercept: Column, value: Column) -> Column:
    """x at which the line has the value; null without slope."""
    return F.try_divide(value - intercept, slope)


def linear_fit(x: Column, y: Column) -> tuple[Column, Column]:
    """(slope, intercept) aggregates of the least-squares line."""
    return F.regr_slope(y, x), F.regr_intercept(y, x)
