"""Coordinate and box helpers on plain columns (boxes are structs x1,y1,x2,y2; points x,y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .strings import col


def point(x, y) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*[col(c).cast("double").alias(n)
                      for c, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))])


def clamp(c, low=0.0, high=1.0) -> Column:
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.least(F.greatest(col(c), lo), hi)


def in_unit(p) -> Column:
    p = col(p)
    return p["x"].between(0, 1) & p["y"].between(0, 1)


def to_unit(x, y, w, h) -> Column:
    """Pixel position as a share of the screen; null outside of it."""
    p = point(F.try_divide(col(x), col(w)), F.try_divide(col(y), col(h)))
    return F.when(in_unit(p), p)


def to_pixel(p, w, h, clamped: bool = False) -> Column:
    """Unit position in whole pixels, rounded half to even; clamped keeps it on the screen."""
    p = col(p)
    px, py = F.bround(p["x"] * col(w)).cast("int"), F.bround(p["y"] * col(h)).cast("int")
    if clamped:
        px = F.least(F.greatest(px, F.lit(0)), col(w).cast("int") - 1)
        py = F.least(F.greatest(py, F.lit(0)), col(h).cast("int") - 1)
    return F.struct(px.alias("x"), py.alias("y"))


def from_space(cx, cy, space, w, h, rw, rh, clamped: bool = False) -> Column:
    """Divide a model coordinate by what its space measures: resized image, 1000 or original."""
    s = col(space)
    dx = F.when(s == "pixel", col(rw)).when(s == "rel1000", F.lit(1000)).when(s == "original", col(w))
    dy = F.when(s == "pixel", col(rh)).when(s == "rel1000", F.lit(1000)).when(s == "original", col(h))
    x, y = F.try_divide(col(cx), dx), F.try_divide(col(cy), dy)
    return point(clamp(x), clamp(y)) if clamped else point(x, y)


def auto_unit(p, w, h) -> Column:
    """A point with a part above 1 is in pixels: divide by the model's size and cap at 1."""
    p = col(p)
    pixel = point(F.least(F.try_divide(p["x"], col(w)), F.lit(1.0)),
                  F.least(F.try_divide(p["y"], col(h)), F.lit(1.0)))
    known = col(w).isNotNull() & col(h).isNotNull()
    return F.when((F.greatest(p["x"], p["y"]) > 1) & known, pixel).otherwise(p)


def rescale_box(b, w, h, rw, rh) -> Column:
    b = col(b)
    sx, sy = F.try_divide(col(rw), col(w)), F.try_divide(col(rh), col(h))
    return box(b["x1"] * sx, b["y1"] * sy, b["x2"] * sx, b["y2"] * sy)


def crop_window(bx, by, bw, bh, w, h, view_w: int = V.VIEW_W, view_h: int = V.VIEW_H) -> Column:
    """A fixed window centred on the target as far as the page allows (int x0,y0,x1,y1)."""
    def axis(start, size, page, view):
        room = F.greatest(col(page) - view, F.lit(0))
        return clamp(col(start) + col(size) / 2 - view / 2, 0, room).cast("int")

    x0, y0 = axis(bx, bw, w, view_w), axis(by, bh, h, view_h)
    return F.struct(x0.alias("x0"), y0.alias("y0"),
                    F.least(x0 + view_w, col(w).cast("int")).alias("x1"),
                    F.least(y0 + view_h, col(h).cast("int")).alias("y1"))


def translate_box(bx, by, bw, bh, window) -> Column:
    """The target inside a window, clamped to it; null when its corner lies outside."""
    win = col(window)
    cw, ch = win["x1"] - win["x0"], win["y1"] - win["y0"]
    x, y = col(bx) - win["x0"], col(by) - win["y0"]
    inside = (x >= 0) & (x < cw) & (y >= 0) & (y < ch)
    return F.when(inside, box(clamp(x, 0, cw), clamp(y, 0, ch),
                              clamp(x + col(bw), 0, cw), clamp(y + col(bh), 0, ch)))


def scale_factor(w, h, long_edge, max_pixels) -> Column:
    """Shrink factor for an image: long edge and pixel budget hold, never above 1."""
    w, h = col(w), col(h)
    return F.when((w > 0) & (h > 0), F.least(
        F.lit(1.0), F.lit(float(long_edge)) / F.greatest(w, h),
        F.sqrt(F.lit(float(max_pixels)) / (w.cast("double") * h))))


def quad_to_box(quad, w, h) -> Column:
    """Axis-aligned unit box around corner points (array of x,y structs), every side clamped."""
    xs, ys = F.transform(col(quad), lambda p: p["x"]), F.transform(col(quad), lambda p: p["y"])
    return box(clamp(F.try_divide(F.array_min(xs), col(w))), clamp(F.try_divide(F.array_min(ys), col(h))),
               clamp(F.try_divide(F.array_max(xs), col(w))), clamp(F.try_divide(F.array_max(ys), col(h))))


def box_center(b) -> Column:
    b = col(b)
    return point((b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2)


def box_area(b) -> Column:
    b = col(b)
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def contains(b, p, pad: float = 0.0) -> Column:
    """Point in box, borders included, the box widened by ``pad`` on every side."""
    b, p = col(b), col(p)
    return ((p["x"] >= b["x1"] - pad) & (p["x"] <= b["x2"] + pad)
            & (p["y"] >= b["y1"] - pad) & (p["y"] <= b["y2"] + pad))


def iou(a, b) -> Column:
    a, b = col(a), col(b)
    zero = F.lit(0.0)
    inter = (F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
             * F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])))
    union = box_area(a) + box_area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def icon_likeness(b, typical: float = V.CV_TYPICAL_SIDE) -> Column:
    """Distance of the longer side from the usual icon size; smaller is more icon-like."""
    b = col(b)
    return F.abs(F.greatest(b["x2"] - b["x1"], b["y2"] - b["y1"]) - typical)


def distance(p, q) -> Column:
    p, q = col(p), col(q)
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])
