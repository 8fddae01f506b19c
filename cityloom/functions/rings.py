"""Measures of rings: arrays of structs (x, y), closed from the last point to the first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sides(ring: Column, f: Callable) -> Column:
    """The sum of f(point, next point) over all sides."""
    after = lambda i: F.get(ring, (i + 1) % F.size(ring))
    return F.aggregate(F.transform(ring, lambda p, i: f(p, after(i))), F.lit(0.0), lambda s, v: s + v)


def _cross(p: Column, q: Column) -> Column:
    return p["x"] * q["y"] - q["x"] * p["y"]


def area(ring: Column) -> Column:
    return F.abs(_sides(ring, _cross)) / 2


def perimeter(ring: Column) -> Column:
    return _sides(ring, lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))


def centroid(ring: Column, axis: str) -> Column:
    """One coordinate of the centroid; null for a ring without area."""
    return F.try_divide(_sides(ring, lambda p, q: (p[axis] + q[axis]) * _cross(p, q)), 3 * _sides(ring, _cross))


def holds(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside, by the sides that a ray to the right crosses."""
    over = lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < p["x"] + (q["x"] - p["x"]) * F.try_divide(y - p["y"], q["y"] - p["y"]))
    return _sides(ring, lambda p, q: F.when(over(p, q), 1.0).otherwise(0.0)) % 2 == 1


def orientation_penalty(ring: Column, angle: float) -> Column:
    """Sum over sides of length * min(|sin|, |cos|) of the angle to an axis."""
    c, s = F.cos(F.lit(angle)), F.sin(F.lit(angle))
    turned = lambda p, q: F.least(F.abs((q["x"] - p["x"]) * c + (q["y"] - p["y"]) * s), F.abs((q["y"] - p["y"]) * c - (q["x"] - p["x"]) * s))
    return _sides(ring, turned)
