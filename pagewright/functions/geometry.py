"""Boxes as column expressions. A box is given as left, top, right, bottom."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def ordered(a: Column, b: Column, places: int = 5) -> tuple[Column, Column]:
    return F.round(F.least(a, b), places), F.round(F.greatest(a, b), places)


def from_pdf(left: Column, bottom: Column, right: Column, top: Column, width: Column, height: Column, rotation: Column) -> Box:
    """A box in points from the lower left corner as shares of the page as it is seen, from the upper left; other
    rotations than 90, 180 and 270 count as none."""
    l, b, r, t = left / width, bottom / height, right / width, top / height
    turn = lambda zero, q1, half, q3: F.when(rotation == 90, q1).when(rotation == 180, half).when(rotation == 270, q3).otherwise(zero)
    x1, x2 = turn(l, b, 1 - r, 1 - t), turn(r, t, 1 - l, 1 - b)
    y1, y2 = turn(1 - t, l, b, 1 - r), turn(1 - b, r, t, 1 - l)
    (left_, right_), (top_, bottom_) = ordered(_clamped(x1), _clamped(x2)), ordered(_clamped(y1), _clamped(y2))
    return left_, top_, right_, bottom_


def normalized(left: Column, top: Column, right: Column, bottom: Column, width: Column | None = None, height: Column | None = None) -> Box:
    """Shares of a page from pixels or shares: divided by the size unless both far sides are at most 1."""
    if width is not None:
        share = (right <= 1) & (bottom <= 1)
        left, right = (F.when(share, x).otherwise(x / width) for x in (left, right))
        top, bottom = (F.when(share, x).otherwise(x / height) for x in (top, bottom))
    (left, right), (top, bottom) = ordered(_clamped(left), _clamped(right)), ordered(_clamped(top), _clamped(bottom))
    return left, top, right, bottom


def is_valid(left: Column, top: Column, right: Column, bottom: Column, is_normalized: Column) -> Column:
    inside = lambda c: (c >= -1e-4) & (c <= 1 + 1e-4)
    return (left <= right) & (top <= bottom) & (~is_normalized | (inside(left) & inside(top) & inside(right) & inside(bottom)))


def area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def iou(a: Box, b: Box, places: int = 4) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when((both > 0) & (union > 0), F.round(both / union, places)).otherwise(0.0)


def polygon_box(points: Column) -> Box:
    """Of an array of (x, y) structs."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)
