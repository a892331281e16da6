"""Boxes as four double columns; expressions for measures between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))

    def width(self) -> Column:
        return F.greatest(F.lit(0.0), self.x1 - self.x0)

    def height(self) -> Column:
        return F.greatest(F.lit(0.0), self.y1 - self.y0)

    def area(self) -> Column:
        return self.width() * self.height()

    def grown(self, by: float) -> Box:
        return Box(self.x0 - by, self.y0 - by, self.x1 + by, self.y1 + by)

    def centre(self) -> tuple[Column, Column]:
        return (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2


def intersection(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)) * F.greatest(zero, F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))


def iou(a: Box, b: Box) -> Column:
    both = intersection(a, b)
    union = a.area() + b.area() - both
    return F.when(union > 0, both / union).otherwise(0.0)


def containment(inner: Box, outer: Box) -> Column:
    """Share of the inner box that lies in the outer one; 0 for an empty box."""
    return F.when(inner.area() > 0, intersection(inner, outer) / inner.area()).otherwise(0.0)


def centre_in(inner: Box, outer: Box) -> Column:
    x, y = inner.centre()
    return x.between(outer.x0, outer.x1) & y.between(outer.y0, outer.y1)


def y_overlap(a: Box, b: Box) -> Column:
    """Vertical overlap as a share of the shorter box."""
    shared = F.greatest(F.lit(0.0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))
    return shared / F.greatest(F.lit(1e-6), F.least(a.y1 - a.y0, b.y1 - b.y0))


def touches(a: Box, b: Box) -> Column:
    return (a.x0 <= b.x1) & (b.x0 <= a.x1) & (a.y0 <= b.y1) & (b.y0 <= a.y1)


def centre_distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = a.centre(), b.centre()
    return F.sqrt(F.pow(ax - bx, 2) + F.pow(ay - by, 2))


def valid(b: Box) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return finite(b.x0) & finite(b.y0) & finite(b.x1) & finite(b.y1) & (b.x0 <= b.x1) & (b.y0 <= b.y1)


def polygon(b: Box) -> Column:
    """The eight coordinates of the corners, clockwise from the top left."""
    return F.array(b.x0, b.y0, b.x1, b.y0, b.x1, b.y1, b.x0, b.y1)


def polygon_box(poly: Column) -> Column:
    xs = F.filter(poly, lambda _, i: i % 2 == 0)
    ys = F.filter(poly, lambda _, i: i % 2 == 1)
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def flipped(b: Box, page_height: Column, scale: Column) -> Box:
    """From a bottom-left to a top-left origin, rescaled, with ordered corners."""
    ya, yb = (page_height - b.y0) * scale, (page_height - b.y1) * scale
    xa, xb = b.x0 * scale, b.x1 * scale
    return Box(F.least(xa, xb), F.least(ya, yb), F.greatest(xa, xb), F.greatest(ya, yb))


def mostly_inside(inner: Box, outer: Box, share: float = 0.7) -> Column:
    return containment(inner, outer) >= share


def area_fraction(b: Box, width: Column, height: Column) -> Column:
    return F.try_divide(b.area(), width * height)


def aspect(b: Box) -> Column:
    """Width over height; NULL for a flat box."""
    return F.try_divide(b.x1 - b.x0, b.y1 - b.y0)


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(100 * part, whole)


def overlay(b: Box, width: Column, height: Column) -> Column:
    """Place and size of a box in percent of its page, as a style."""
    return F.format_string("left:%.3f%%;top:%.3f%%;width:%.3f%%;height:%.3f%%", percent(b.x0, width), percent(b.y0, height), percent(b.x1 - b.x0, width), percent(b.y1 - b.y0, height))


def absolute(b: Box, width: Column, height: Column) -> Box:
    """A box given in shares of the page, in its units."""
    return Box(b.x0 * width, b.y0 * height, b.x1 * width, b.y1 * height)


def verdict(box: Column) -> Column:
    """ok, or what is wrong with an array of numbers as a box."""
    odd = F.exists(box, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(box.isNull(), "missing").when(F.size(box) != 4, "size").when(odd, "not_finite").when((box[0] > box[2]) | (box[1] > box[3]), "unordered").otherwise("ok")


def strict(box: Column) -> Column:
    """The box of an array of numbers as a struct, or NULL."""
    return F.when(verdict(box) == "ok", F.struct(*(F.get(box, F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1")))))


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """95 % interval of a share as a struct; NULL without cases."""
    p = hits / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), mid - half).alias("low"), F.least(F.lit(1.0), mid + half).alias("high")))
