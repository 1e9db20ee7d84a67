"""Boxes as struct columns (x1, y1, x2, y2) and the arithmetic on them; all of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the three image transforms.
SCALE_FACTOR = 1.03
SHIFT = 8.0
BRIGHTNESS = 1.10


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)])


def _sides(b: Column) -> list[Column]:
    return [b.getField(n) for n in ("x1", "y1", "x2", "y2")]


def _at_least_zero(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def area(b: Column) -> Column:
    x1, y1, x2, y2 = _sides(b)
    return _at_least_zero(x2 - x1) * _at_least_zero(y2 - y1)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the boxes don't meet, have no area or a side that is NaN. Null for a null box.

    What boxes share is no larger than either, so their union is never below zero and no case but that of nothing over
    nothing needs a branch, which would repeat it all: code that is generated of over 8,000 bytes a method is never compiled.
    """
    ax1, ay1, ax2, ay2 = _sides(a)
    bx1, by1, bx2, by2 = _sides(b)
    meet = _at_least_zero(F.least(ax2, bx2) - F.greatest(ax1, bx1)) * _at_least_zero(F.least(ay2, by2) - F.greatest(ay1, by1))
    value = F.coalesce(F.nanvl(F.try_divide(meet, area(a) + area(b) - meet), F.lit(0.0)), F.lit(0.0)) + 0.0  # no negative zero
    return F.when(a.isNotNull() & b.isNotNull(), value)


def _within(x: Column, high: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), high.cast("double"))


def clip_box(b: Column, width: Column, height: Column) -> Column:
    """Each side within the image, then the corners in order."""
    x1, y1, x2, y2 = (_within(s, high) for s, high in zip(_sides(b), (width, height, width, height), strict=True))
    return box(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))


def remap_scale(b: Column, width: Column, height: Column, factor: float = SCALE_FACTOR) -> Column:
    cx, cy = width / F.lit(2.0), height / F.lit(2.0)
    x1, y1, x2, y2 = _sides(b)
    return clip_box(box(*[c + (s - c) * F.lit(factor) for s, c in ((x1, cx), (y1, cy), (x2, cx), (y2, cy))]), width, height)


def remap_translate(b: Column, width: Column, height: Column, dx: float = SHIFT, dy: float = SHIFT) -> Column:
    x1, y1, x2, y2 = _sides(b)
    return clip_box(box(x1 + dx, y1 + dy, x2 + dx, y2 + dy), width, height)


def remap_brightness(b: Column, width: Column, height: Column, factor: float = BRIGHTNESS) -> Column:
    return clip_box(b, width, height)


REMAPS = {"scale": remap_scale, "translate": remap_translate, "brightness": remap_brightness}


def remap(b: Column, width: Column, height: Column, transform: str, **options: float) -> Column:
    if transform not in REMAPS:
        raise ValueError(f"unknown transform {transform!r}; known: {', '.join(REMAPS)}")
    return REMAPS[transform](b, width, height, **options)


def normalised_from_corners(b: Column, width: Column, height: Column) -> Column:
    """struct(cx, cy, w, h) in shares of the image after clipping the corners; null without area."""
    x1, y1, x2, y2 = (_within(s, high) for s, high in zip(_sides(b), (width, height, width, height), strict=True))
    out = F.struct(
        F.try_divide((x1 + x2) / 2, width).alias("cx"),
        F.try_divide((y1 + y2) / 2, height).alias("cy"),
        F.try_divide(x2 - x1, width).alias("w"),
        F.try_divide(y2 - y1, height).alias("h"),
    )
    return F.when((x2 > x1) & (y2 > y1), out)


def xywh_to_normalised(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The same from a corner and a size, as annotation documents have them."""
    return normalised_from_corners(box(x, y, x + w, y + h), width, height)


def xywh_to_clamped(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Centre and size each clamped to [0, 1] by itself; null if the clamped size is empty."""
    unit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    cx, cy = unit(F.try_divide(x + w / 2, width)), unit(F.try_divide(y + h / 2, height))
    nw, nh = unit(F.try_divide(w, width)), unit(F.try_divide(h, height))
    return F.when((nw > 0) & (nh > 0), F.struct(cx.alias("cx"), cy.alias("cy"), nw.alias("w"), nh.alias("h")))


def leaves_image(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return (x < 0) | (y < 0) | (x + w > width) | (y + h > height)


def letterbox(b: Column, width: Column, height: Column, size: Column) -> Column:
    """The box in the square image of `size` into which the image is scaled and centred."""
    ratio = F.least(size / height, size / width)
    left, top = (size - width * ratio) / 2, (size - height * ratio) / 2
    x1, y1, x2, y2 = _sides(b)
    return box(x1 * ratio + left, y1 * ratio + top, x2 * ratio + left, y2 * ratio + top)


def centre_to_corners(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)
