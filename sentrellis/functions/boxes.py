"""Geometry of boxes and images. A box is a struct (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))


def from_centre(x: Column, y: Column, w: Column, h: Column, width: float | Column = 1.0, height: float | Column = 1.0) -> Column:
    """A box from its normalised centre and size, in pixels of an image."""
    return box((x - w / 2) * width, (y - h / 2) * height, (x + w / 2) * width, (y + h / 2) * height)


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes apart or without area."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    common = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def edge_distance(x: Column, y: Column) -> Column:
    """Distance of a normalised centre from the nearest edge of the image."""
    return F.least(x, 1 - x, y, 1 - y)


def expand(b: Column, share: float, width: Column, height: Column) -> Column:
    """A box made larger by a share of its size on every side, within the image."""
    w, h = (b["x2"] - b["x1"]) * share, (b["y2"] - b["y1"]) * share
    zero = F.lit(0.0)
    return box(F.greatest(zero, b["x1"] - w), F.greatest(zero, b["y1"] - h), F.least(width, b["x2"] + w), F.least(height, b["y2"] + h))


def distinct_boxes(boxes: Column, threshold: float = 0.2, accepted: Column | None = None) -> Column:
    """Boxes taken in order, each unless it overlaps one already taken by more than ``threshold``."""
    kind = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
    start = F.array().cast(kind) if accepted is None else accepted
    return F.aggregate(boxes, start, lambda acc, b: F.when(F.exists(acc, lambda a: iou(a, b) > threshold), acc).otherwise(F.concat(acc, F.array(b))))


def best_resolution(width: Column, height: Column, options: list[tuple[int, int]]) -> Column:
    """The option that shows most of an image, then wastes least, then comes first."""
    fits = []
    for k, (w, h) in enumerate(options):
        scale = F.least(w / width, h / height)
        shown = F.least(F.floor(width * scale) * F.floor(height * scale), width.cast("long") * height.cast("long"))
        fits.append(F.struct((-shown).alias("shown"), (w * h - shown).alias("wasted"), F.lit(k).alias("k"), F.lit(w).alias("width"), F.lit(h).alias("height")))
    best = F.array_min(F.array(*fits))
    return F.struct(best["width"].alias("width"), best["height"].alias("height"))


def resize_and_pad(width: Column, height: Column, to_width: Column, to_height: Column) -> Column:
    """New size of an image that keeps its shape within a target, and the offset that centres it."""
    sw, sh = to_width / width, to_height / height
    w = F.when(sw < sh, to_width).otherwise(F.least(F.ceil(width * sh), to_width)).cast("long")
    h = F.when(sw < sh, F.least(F.ceil(height * sw), to_height)).otherwise(to_height).cast("long")
    return F.struct(w.alias("width"), h.alias("height"), F.floor((to_width - w) / 2).alias("x"), F.floor((to_height - h) / 2).alias("y"))


def square_padding(width: Column, height: Column) -> Column:
    """Side of the square that an image is padded to, and the offset of the image in it."""
    side = F.greatest(width, height)
    return F.struct(side.alias("side"), F.floor((side - width) / 2).alias("x"), F.floor((side - height) / 2).alias("y"))


def patches(width: Column, height: Column, size: int) -> Column:
    """Corners of the patches of an image, row by row."""
    step = lambda n: F.sequence(F.lit(0).cast("long"), F.greatest(n.cast("long") - 1, F.lit(0)), F.lit(size).cast("long"))
    return F.flatten(F.transform(step(height), lambda y: F.transform(step(width), lambda x: F.struct(x.alias("x"), y.alias("y")))))


def unpadded(width: Column, height: Column, grid_width: Column, grid_height: Column) -> Column:
    """Rows or columns of a grid that only pad an image of this shape, on each side."""
    wide = width / height > grid_width / grid_height
    rows = F.floor((grid_height - F.floor(height * (grid_width / width))) / 2)
    cols = F.floor((grid_width - F.floor(width * (grid_height / height))) / 2)
    zero = F.lit(0).cast("long")
    return F.struct(F.when(wide, rows).otherwise(zero).alias("rows"), F.when(wide, zero).otherwise(cols).alias("columns"))
