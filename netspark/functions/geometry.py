"""Points, angles and curves in the plane as Column expressions; a point is (x, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def distance(a: Point, b: Point) -> Column:
    return F.sqrt(F.pow(b[0] - a[0], 2) + F.pow(b[1] - a[1], 2))


def angle(a: Point, b: Point) -> Column:
    return F.atan2(b[1] - a[1], b[0] - a[0])


def on_circle(center: Point, radius, at: Column) -> Point:
    return center[0] + radius * F.cos(at), center[1] + radius * F.sin(at)


def toward(a: Point, b: Point, far) -> Point:
    """The point so far from a on the way to b."""
    return on_circle(a, far, angle(a, b))


def border(center: Point, other: Point, size, x_scale: float = 1.0, y_scale: float = 1.0) -> Point:
    """Where a line to the other point leaves a node of this size, axes scaled apart."""
    at = F.atan2((other[1] - center[1]) / y_scale, (other[0] - center[0]) / x_scale)
    return center[0] + size * F.cos(at) * x_scale, center[1] + size * F.sin(at) * y_scale


def control(a: Point, b: Point, curvature, pivot: float = 0.5, shape: float = 0.0) -> Point:
    """The control point of a curve from a to b: at `pivot` of the way, off it by curvature times the length; a shape above 0 flattens."""
    pivot, bend = min(max(pivot, 0.0), 1.0), 1 - min(max(shape, -1.0), 1.0) / 2
    off = curvature * bend  # the unit normal times the length is (-dy, dx)
    return a[0] + pivot * (b[0] - a[0]) - off * (b[1] - a[1]), a[1] + pivot * (b[1] - a[1]) + off * (b[0] - a[0])


def bezier(df: DataFrame, a: Point, mid: Point, b: Point, n: int = 50) -> DataFrame:
    """df with n rows (step, x, y) for each of its own, along the quadratic curve."""
    t = F.col("step") / (n - 1)
    axis = lambda i: F.pow(1 - t, 2) * a[i] + 2 * (1 - t) * t * mid[i] + F.pow(t, 2) * b[i]
    return df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("x", axis(0)).withColumn("y", axis(1))
