"""Column expressions over boxes (x, y, width, height)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """The columns of one box; prefix "a_" names a_x, a_y, a_width, a_height."""

    prefix: str = ""

    def __getattr__(self, name: str) -> Column:
        return F.col(f"{self.prefix}{name}")

    @property
    def right(self) -> Column:
        return self.x + self.width

    @property
    def bottom(self) -> Column:
        return self.y + self.height

    @property
    def center_x(self) -> Column:
        return self.x + self.width / 2

    @property
    def center_y(self) -> Column:
        return self.y + self.height / 2

    @property
    def area(self) -> Column:
        return self.width * self.height


def overlap_x(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), F.least(a.right, b.right) - F.greatest(a.x, b.x))


def overlap_y(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y))


def gap_x(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), F.greatest(a.x, b.x) - F.least(a.right, b.right))


def gap_y(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), F.greatest(a.y, b.y) - F.least(a.bottom, b.bottom))


def center_distance(a: Box, b: Box) -> Column:
    return F.hypot(a.center_x - b.center_x, a.center_y - b.center_y)


def box_distance(a: Box, b: Box) -> Column:
    return F.hypot(gap_x(a, b), gap_y(a, b))


def intersects(a: Box, b: Box) -> Column:
    """Strict: boxes that only touch don't."""
    return (a.x < b.right) & (b.x < a.right) & (a.y < b.bottom) & (b.y < a.bottom)


def contains(a: Box, b: Box) -> Column:
    return (a.x <= b.x) & (a.y <= b.y) & (a.right >= b.right) & (a.bottom >= b.bottom)


def contains_point(a: Box, x: Column, y: Column) -> Column:
    return (a.x <= x) & (x <= a.right) & (a.y <= y) & (y <= a.bottom)


def intersection_area(a: Box, b: Box) -> Column:
    return overlap_x(a, b) * overlap_y(a, b)


def iou(a: Box, b: Box) -> Column:
    both = intersection_area(a, b)
    union = a.area + b.area - both
    return F.when(union > 0, both / union).otherwise(0.0)


def overlap_ratio(overlap: Column, extent_a: Column, extent_b: Column) -> Column:
    """Overlap over the smaller extent; 0 where that has none."""
    least = F.least(extent_a, extent_b)
    return F.when(least > 0, overlap / least).otherwise(0.0)
