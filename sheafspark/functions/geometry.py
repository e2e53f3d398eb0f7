"""Box geometry as Column arithmetic. A box is four columns x1, y1, x2, y2 (a tuple here)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def area(b: Box, pixel: int = 0) -> Column:
    return (b[2] - b[0] + pixel) * (b[3] - b[1] + pixel)


def intersection(a: Box, b: Box, pixel: int = 0) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + pixel) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + pixel)


def iou(a: Box, b: Box, pixel: int = 0) -> Column:
    """Intersection over union; pixel=1 counts both edges. 0 where nothing is covered."""
    both = intersection(a, b, pixel)
    whole = area(a, pixel) + area(b, pixel) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def share_of(a: Box, b: Box) -> Column:
    """How much of a lies in b."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(0.0)


def contained(a: Box, b: Box, least: float = 0.8) -> Column:
    return share_of(a, b) >= least


def smaller_share(a: Box, b: Box) -> Column:
    small = F.least(area(a), area(b))
    return F.when(small > 0, intersection(a, b) / small).otherwise(0.0)


def horizontal_share(a: Box, b: Box) -> Column:
    """Overlap of the widths over the first width."""
    over = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    return F.when(a[2] > a[0], over / (a[2] - a[0])).otherwise(0.0)


def narrower_share(a: Box, b: Box) -> Column:
    over = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    small = F.least(a[2] - a[0], b[2] - b[0])
    return F.when(small > 0, over / small).otherwise(0.0)


def edge_distance(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    return F.hypot(F.greatest(zero, a[0] - b[2], b[0] - a[2]), F.greatest(zero, a[1] - b[3], b[1] - a[3]))


def center_distance(a: Box, b: Box) -> Column:
    return F.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)


def relative(a: Box, b: Box) -> Column:
    """Whether b lies left of, right of, above or below a."""
    return F.struct((b[2] < a[0]).alias("left"), (a[2] < b[0]).alias("right"), (b[3] < a[1]).alias("top"), (a[3] < b[1]).alias("bottom"))


def unclip(b: Box, ratio: Column | float) -> Box:
    """b scaled about its centre."""
    r = F.lit(ratio) if not isinstance(ratio, Column) else ratio
    cx, cy, w, h = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, (b[2] - b[0]) * r / 2, (b[3] - b[1]) * r / 2
    return cx - w, cy - h, cx + w, cy + h


def to_xywh(b: Box) -> Box:
    return b[0], b[1], b[2] - b[0], b[3] - b[1]


def to_xyxy(b: Box) -> Box:
    return b[0], b[1], b[0] + b[2], b[1] + b[3]


def of_points(xs: Column, ys: Column) -> Box:
    """The box around points; edges below 0 are 0."""
    zero = F.lit(0.0)
    return F.greatest(zero, F.array_min(xs)), F.greatest(zero, F.array_min(ys)), F.greatest(zero, F.array_max(xs)), F.greatest(zero, F.array_max(ys))


def corners(b: Box) -> Column:
    return F.array(b[0], b[1], b[2], b[1], b[2], b[3], b[0], b[3])


def affine(b: Box, sx: Column, sy: Column, dx: Column, dy: Column) -> Box:
    return b[0] * sx + dx, b[1] * sy + dy, b[2] * sx + dx, b[3] * sy + dy


def compose(outer: tuple, inner: tuple) -> tuple:
    """Of (sx, sy, dx, dy): outer after inner."""
    return outer[0] * inner[0], outer[1] * inner[1], outer[0] * inner[2] + outer[2], outer[1] * inner[3] + outer[3]


def resized(w: Column, h: Column, factor: int = 28, least: int = 56 * 56, most: int = 28 * 28 * 1280) -> tuple[Column, Column]:
    """Width and height rounded to the factor (halves to even), scaled where the pixels are out of bounds."""
    near = lambda v: F.greatest(F.lit(factor), (F.bround(v / factor) * factor).cast("int"))
    rw, rh, pixels = near(w), near(h), (w * h).cast("double")
    down, up = F.sqrt(pixels / most), F.sqrt(F.lit(float(least)) / pixels)
    low = lambda v: F.greatest(F.lit(factor), (F.floor(v / down / factor) * factor).cast("int"))
    high = lambda v: (F.ceil(v * up / factor) * factor).cast("int")
    pick = lambda v, r: F.when(rw * rh > most, low(v)).when(rw * rh < least, high(v)).otherwise(r)
    return pick(w, rw), pick(h, rh)


def small_picture(b: Box, width: Column, height: Column) -> Column:
    w, h = b[2] - b[0], b[3] - b[1]
    return (w < width * 0.1) | (h < height * 0.1) | (w * h < width * height * 0.01)


def fitted(w: Column, h: Column, most: int = 1124) -> tuple[Column, Column]:
    """Width and height brought to a longest side of ``most``, cut to whole numbers; smaller ones stay."""
    side = F.greatest(w, h)
    cut = lambda v: F.when(side > most, F.floor(v * most / side).cast("int")).otherwise(v.cast("int"))
    return cut(w), cut(h)


def region(w: Column, h: Column, box: tuple[int, int, int, int]) -> tuple[Column, ...]:
    """A region given in thousandths of a picture, in its pixels."""
    return tuple(F.floor(v * k / 1000).cast("int") for v, k in zip((w, h, w, h), box, strict=True))
