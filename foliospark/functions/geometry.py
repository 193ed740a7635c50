"""Box arithmetic as column expressions over x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(name: str, prefix: str = "") -> Column:
    return F.col(prefix + name)


def width(p: str = "") -> Column:
    return c("x2", p) - c("x1", p)


def height(p: str = "") -> Column:
    return c("y2", p) - c("y1", p)


def area(p: str = "") -> Column:
    return width(p) * height(p)


def center_x(p: str = "") -> Column:
    return (c("x1", p) + c("x2", p)) / 2


def center_y(p: str = "") -> Column:
    return (c("y1", p) + c("y2", p)) / 2


def overlaps(p: str, q: str) -> Column:
    """Closed intervals: boxes that touch overlap."""
    return (c("x1", p) <= c("x2", q)) & (c("x2", p) >= c("x1", q)) & (c("y1", p) <= c("y2", q)) & (c("y2", p) >= c("y1", q))


def intersection_area(p: str, q: str) -> Column:
    """Null where the boxes don't overlap or only touch."""
    w = F.least(c("x2", p), c("x2", q)) - F.greatest(c("x1", p), c("x1", q))
    h = F.least(c("y2", p), c("y2", q)) - F.greatest(c("y1", p), c("y1", q))
    return F.when((w > 0) & (h > 0), w * h)


def overlap_ratio(p: str, q: str) -> Column:
    return F.coalesce(intersection_area(p, q) / F.least(area(p), area(q)), F.lit(0.0))


def significant_overlap(p: str, q: str, threshold: float = 0.3) -> Column:
    return overlap_ratio(p, q) > F.lit(threshold)


def contains(outer: str, inner: str) -> Column:
    return (c("x1", inner) >= c("x1", outer)) & (c("x2", inner) <= c("x2", outer)) & (c("y1", inner) >= c("y1", outer)) & (c("y2", inner) <= c("y2", outer))


def bounds(boxes: str) -> Column:
    """Union box of an array of structs with x1..y2; null for an empty array."""
    edge = lambda f, side: f(F.transform(boxes, lambda b: b[side]))
    return F.when(F.size(boxes) > 0, F.struct(edge(F.array_min, "x1").alias("x1"), edge(F.array_min, "y1").alias("y1"), edge(F.array_max, "x2").alias("x2"), edge(F.array_max, "y2").alias("y2")))


def spatially_close(p: str, q: str, factor: float = 2.0) -> Column:
    return (F.abs(c("y1", p) - c("y1", q)) < (height(p) + height(q)) / 2 * factor) & (F.abs(c("x1", p) - c("x1", q)) < (width(p) + width(q)) / 2 * factor)


def proximate(p: str, q: str, factor: float = 2.0) -> Column:
    dx, dy = center_x(p) - center_x(q), center_y(p) - center_y(q)
    return F.sqrt(dx * dx + dy * dy) < (width(p) + height(p) + width(q) + height(q)) / 4 * factor
