"""Boxes ``(x1, y1, x2, y2)`` and intervals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1, y1, x2, y2) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def area(b: Column) -> Column:
    return F.greatest(b.x2 - b.x1, F.lit(0.0)) * F.greatest(b.y2 - b.y1, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; null if both are empty."""
    w = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0.0))
    h = F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), F.lit(0.0))
    return F.try_divide(w * h, area(a) + area(b) - w * h)


def centre_inside(inner: Column, outer: Column, margin: float = 0.1) -> Column:
    """Whether the centre of ``inner`` lies in ``outer`` widened by ``margin`` of its size on each side."""
    cx, cy = (inner.x1 + inner.x2) / 2, (inner.y1 + inner.y2) / 2
    mx, my = (outer.x2 - outer.x1) * margin, (outer.y2 - outer.y1) * margin
    return cx.between(outer.x1 - mx, outer.x2 + mx) & cy.between(outer.y1 - my, outer.y2 + my)


def side(b: Column, width: Column) -> Column:
    """``left`` or ``right`` of the middle of an image."""
    return F.when((b.x1 + b.x2) / 2 < width / 2, "left").otherwise("right")


def interval_distance(x: Column, low: Column, high: Column) -> Column:
    """0 inside [low, high], else the distance to the nearer end."""
    return F.greatest(low - x, F.lit(0.0), x - high)


def polygon_box(points: Column) -> Column:
    """The bounding box of an array of [x, y]."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def scaled(b: Column, factor: Column) -> Column:
    return box(b.x1 * factor, b.y1 * factor, b.x2 * factor, b.y2 * factor)


def clipped(b: Column, width: Column, height: Column) -> Column:
    """The box inside the image; null if nothing is left."""
    x1, y1 = F.greatest(b.x1, F.lit(0.0)), F.greatest(b.y1, F.lit(0.0))
    x2, y2 = F.least(b.x2, width), F.least(b.y2, height)
    return F.when((x2 > x1) & (y2 > y1), box(x1, y1, x2, y2))


def crop_window(b: Column, width: Column, height: Column, margin: float = 0.5, largest: float = 512.0) -> Column:
    """A box widened by ``margin`` of its size, cut to the image, with the factor that shrinks it to ``largest``."""
    mx, my = (b.x2 - b.x1) * margin, (b.y2 - b.y1) * margin
    window = clipped(box(b.x1 - mx, b.y1 - my, b.x2 + mx, b.y2 + my), width, height)
    longest = F.greatest(window.x2 - window.x1, window.y2 - window.y1)
    return F.when(window.isNotNull(), F.struct(window.alias("window"), F.least(F.lit(1.0), F.lit(largest) / longest).alias("factor")))


def mapped(b: Column, matrix: list[list[float]]) -> Column:
    """The bounding box of the four corners under a 3 x 3 perspective matrix."""
    m = matrix

    def point(x: Column, y: Column) -> Column:
        w = m[2][0] * x + m[2][1] * y + m[2][2]
        return F.array((m[0][0] * x + m[0][1] * y + m[0][2]) / w, (m[1][0] * x + m[1][1] * y + m[1][2]) / w)

    return polygon_box(F.array(point(b.x1, b.y1), point(b.x2, b.y1), point(b.x2, b.y2), point(b.x1, b.y2)))


def valid_box(values: Column) -> Column:
    """Whether an array is four numbers of at least 0."""
    return F.coalesce((F.size(values) == 4) & F.forall(values, lambda v: v.isNotNull() & (v >= 0)), F.lit(False))


def clockwise(points: Column) -> Column:
    """Four points from the top left on, clockwise: the two leftmost and the two rightmost, each by height."""
    by_x = F.array_sort(F.transform(points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    by_y = lambda a, i: F.get(F.array_sort(F.transform(a, lambda p: F.struct(p.y.alias("y"), p.x.alias("x")))), i)
    left, right = F.slice(by_x, 1, 2), F.slice(by_x, 3, 2)
    return F.transform(F.array(by_y(left, 0), by_y(right, 0), by_y(right, 1), by_y(left, 1)), lambda p: F.array(p.x, p.y))
