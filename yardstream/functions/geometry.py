"""Box arithmetic on columns.  A box is a tuple of columns (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", owner: str = "") -> Box:
    """The four columns ``{owner}{prefix}x1`` ... ``{prefix}y2``."""
    return tuple(F.col(f"{owner}{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))  # type: ignore[return-value]


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Box:
    return x, y, x + w, y + h


def to_xywh(b: Box) -> Box:
    return b[0], b[1], b[2] - b[0], b[3] - b[1]


def _side(high: Column, low: Column) -> Column:
    return F.greatest(F.lit(0.0), high - low)


def area(b: Box) -> Column:
    return _side(b[2], b[0]) * _side(b[3], b[1])


def intersection(a: Box, b: Box) -> Column:
    return _side(F.least(a[2], b[2]), F.greatest(a[0], b[0])) * _side(F.least(a[3], b[3]), F.greatest(a[1], b[1]))


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def center(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2.0, (b[1] + b[3]) / 2.0


def center_distance(a: Box, b: Box) -> Column:
    """Distance of the centres, each axis in units of the larger box side."""
    (ax, ay), (bx, by) = center(a), center(b)
    dx = F.abs(ax - bx) / F.greatest(F.lit(1.0), a[2] - a[0], b[2] - b[0])
    dy = F.abs(ay - by) / F.greatest(F.lit(1.0), a[3] - a[1], b[3] - b[1])
    return F.sqrt(dx * dx + dy * dy)


def containment(inner: Box, outer: Box) -> Column:
    """Share of ``inner`` covered by ``outer``."""
    size = area(inner)
    return F.when(size > 0, intersection(inner, outer) / size).otherwise(F.lit(0.0))


def clamp(b: Box, width: float, height: float) -> Box:
    """Clip to the frame; the far corner may touch the frame edge."""
    whole = [F.floor(v).cast("int") for v in b]

    def clip(v: Column, top: float) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(int(top)), v))

    return clip(whole[0], width - 1), clip(whole[1], height - 1), clip(whole[2], width), clip(whole[3], height)


def center_inside(inner: Box, outer: Box, margin: float) -> Column:
    cx, cy = center(inner)
    return cx.between(outer[0] - margin, outer[2] + margin) & cy.between(outer[1] - margin, outer[3] + margin)
