"""Box geometry, as expressions over columns. Boxes are x, y, w, h in whole pixels from the top left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkplane.functions import vocab as V


@dataclass(frozen=True)
class Box:
    x: Column
    y: Column
    w: Column
    h: Column

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h


def box(prefix: str = "") -> Box:
    """The box of the columns <prefix>x, y, w, h."""
    return Box(*[F.col(f"{prefix}{k}") for k in "xywh"])


def overlap(a: Box, b: Box) -> Column:
    """Area of the intersection."""
    w = F.least(a.right, b.right) - F.greatest(a.x, b.x)
    h = F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y)
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Box, b: Box) -> Column:
    shared = overlap(a, b)
    return F.when(shared > 0, shared / (a.area + b.area - shared)).otherwise(F.lit(0.0))


def coverage(a: Box, b: Box) -> Column:
    """Share of a that lies in b."""
    return F.when(a.area > 0, overlap(a, b) / a.area).otherwise(F.lit(0.0))


def holds_center(a: Box, b: Box) -> Column:
    """Whether the center of b lies in a, edges included."""
    cx, cy = b.x + b.w / 2.0, b.y + b.h / 2.0
    return (cx >= a.x) & (cx <= a.right) & (cy >= a.y) & (cy <= a.bottom)


def same_row(a: Box, b: Box) -> Column:
    """Whether the vertical overlap exceeds half the lower height."""
    return F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y) > 0.5 * F.least(a.h, b.h)


def padding_px(tier: Column) -> Column:
    out = F.lit(V.PADDING_PX["good"])
    for k, v in V.PADDING_PX.items():
        out = F.when(tier == k, F.lit(v)).otherwise(out)
    return out


def padded(b: Box, tier: Column, page_w: Column, page_h: Column, multiline: Column, cell: Box, left: Column, right: Column, inset: int = 3) -> dict[str, Column]:
    """The box grown by its tier's padding and held in by, in this order, its cell, its neighbours, the page.

    A cell counts if it has area and shares area with the box. It cuts the box only sideways, and only where the box
    leaves it by more than the inset; neighbours never cut the box. Cell and neighbours may be null.
    """
    pad = padding_px(tier)
    pad_y = F.when(multiline, F.lit(0)).otherwise(pad)
    x1, y1, x2, y2 = b.x - pad, b.y - pad_y, b.right + pad, b.bottom + pad_y
    roomy = (cell.w > 2 * inset) & (cell.h > 2 * inset)
    m = F.when(roomy, F.lit(inset)).otherwise(F.lit(0))
    fits = (b.x >= cell.x - inset) & (b.right <= cell.right + inset)
    cx1, cx2 = F.greatest(x1, cell.x + m), F.least(x2, cell.right - m)
    cx1, cx2 = F.when(fits, F.least(cx1, b.x)).otherwise(cx1), F.when(fits, F.greatest(cx2, b.right)).otherwise(cx2)
    cy1, cy2 = F.least(F.greatest(y1, cell.y + m), b.y), F.greatest(F.least(y2, cell.bottom - m), b.bottom)
    use = F.coalesce((cell.w >= 1) & (cell.h >= 1) & (overlap(b, cell) > 0) & (cx2 > cx1) & (cy2 > cy1), F.lit(False))
    nx1 = F.least(F.greatest(x1, F.coalesce(left, x1)), b.x)
    nx2 = F.greatest(F.least(x2, F.coalesce(right, x2)), b.right)
    px1 = F.greatest(F.lit(0), F.when(use, cx1).otherwise(nx1))
    py1 = F.greatest(F.lit(0), F.when(use, cy1).otherwise(F.least(y1, b.y)))
    px2 = F.least(page_w, F.when(use, cx2).otherwise(nx2))
    py2 = F.least(page_h, F.when(use, cy2).otherwise(F.greatest(y2, b.bottom)))
    return {
        "px": px1.cast("int"), "py": py1.cast("int"), "pw": F.greatest(F.lit(1), (px2 - px1).cast("int")), "ph": F.greatest(F.lit(1), (py2 - py1).cast("int")),
        "cell_clip": use,
    }


def slabs(b: Box, hole: Box) -> Column:
    """What is left of b beside a hole, as the largest of the strips above, below, left and right of it; null if none."""
    names = ("x", "y", "w", "h")

    def strip(rank: int, x: Column, y: Column, w: Column, h: Column) -> Column:
        return F.struct((w * h).cast("long").alias("area"), F.lit(-rank).alias("rank"), *[c.cast("int").alias(n) for c, n in zip((x, y, w, h), names, strict=True)])

    every = F.array(
        strip(0, b.x, b.y, b.w, hole.y - b.y), strip(1, b.x, hole.bottom, b.w, b.bottom - hole.bottom),
        strip(2, b.x, b.y, hole.x - b.x, b.h), strip(3, hole.right, b.y, b.right - hole.right, b.h),
    )
    return F.array_max(F.filter(every, lambda s: (s["w"] > 0) & (s["h"] > 0)))
