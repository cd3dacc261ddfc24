"""Boxes of tiles, crops and faces as integer expressions; pixels are read by a plug-in, not here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far tiles overlap, the margin about a face, and how many faces are looked at.
OVERLAP, MARGIN, MOST_FACES = 0.08, 0.2, 4


def _box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.cast("int").alias("left"), top.cast("int").alias("top"), right.cast("int").alias("right"), bottom.cast("int").alias("bottom"))


def tiles(width: Column, height: Column, overlap: float = OVERLAP) -> Column:
    """The four overlapping quadrants, rows first, of an image of this size; half of a pixel is rounded to the even one."""
    w, h = (F.least(x, F.greatest(F.lit(1), F.bround(x * (0.5 + overlap), 0))) for x in (width, height))
    zero = F.lit(0)
    return F.array(_box(zero, zero, w, h), _box(width - w, zero, width, h), _box(zero, height - h, w, height), _box(width - w, height - h, width, height))


def crop(box: Column, width: Column, height: Column, margin: float = MARGIN) -> Column:
    """A box (x, y, w, h) with a margin, within the image; null if nothing of it is there."""
    x, y = (F.greatest(F.lit(0), box[c]) for c in "xy")
    w, h = (F.greatest(F.lit(1), box[c]) for c in "wh")
    dx, dy = (F.floor(v * margin) for v in (w, h))
    left, top = F.greatest(F.lit(0), x - dx), F.greatest(F.lit(0), y - dy)
    right, bottom = F.least(width, x + w + dx), F.least(height, y + h + dy)
    return F.when((right > left) & (bottom > top), _box(left, top, right, bottom))


def pixels(face: Column, width: Column, height: Column) -> Column:
    """A face in shares of the image, counted from the lower left, as a box in pixels from the upper left; null if it is empty."""
    x, w = F.floor(face["x"] * width).cast("int"), F.floor(face["w"] * width).cast("int")
    y, h = F.floor((1.0 - face["y"] - face["h"]) * height).cast("int"), F.floor(face["h"] * height).cast("int")
    return F.when((face["w"] > 0) & (face["h"] > 0) & (w > 0) & (h > 0), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def largest_first(boxes: Column, most: int | None = None) -> Column:
    """Boxes by area, the largest first, equal ones as they stood."""
    ranked = F.array_sort(F.transform(boxes, lambda b, i: F.struct((-(b["w"] * b["h"])).alias("a"), i.alias("i"), b.alias("b"))))
    found = F.transform(ranked, lambda r: r["b"])
    return F.slice(found, 1, most) if most else found


def parse_faces(value: Column) -> Column:
    """``x,y,w,h+x,y,w,h`` as boxes; parts that are no boxes are left out, blank has none."""
    parts = F.filter(F.split(F.coalesce(value, F.lit("")), r"\+"), lambda p: p.rlike(r"^\s*-?\d+\s*(,\s*-?\d+\s*){3}$"))
    return F.transform(parts, lambda p: F.struct(*[F.trim(F.get(F.split(p, ","), F.lit(i))).cast("int").alias(c) for i, c in enumerate("xywh")]))


def display_size(width: Column, height: Column, orientation: Column) -> Column:
    """Size as shown: orientations 5 to 8 lie on their side."""
    turned = F.coalesce(orientation, F.lit(1)).isin(5, 6, 7, 8)
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def within_budget(width: Column, height: Column, most: int) -> Column:
    """Whether an image has no more pixels than it may; the product is taken as a long."""
    return width.cast("long") * height.cast("long") <= most
