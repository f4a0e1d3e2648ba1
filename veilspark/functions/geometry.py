"""Boxes and coordinate spaces as column functions.

A rect is ``struct<x,y,w,h: double>``. Spaces: CSS viewport, capture (device
pixels), document (scrolled), child frame, and the square model input reached
by a letterbox. Null parts give null results; a NaN is only sure to survive
:func:`iou` and conversions, so :func:`rect_problems` is asked before clamping.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for n, c in zip("xywh", (x, y, w, h))))


def from_array(box: Column) -> Column:
    """A rect from ``[x, y, w, h]``."""
    return rect(*(F.get(box, F.lit(i)) for i in range(4)))


def to_array(r: Column) -> Column:
    return F.array(r["x"], r["y"], r["w"], r["h"])


def from_corners(c: Column) -> Column:
    return rect(c["xmin"], c["ymin"], c["xmax"] - c["xmin"], c["ymax"] - c["ymin"])


def to_corners(r: Column) -> Column:
    return F.struct(r["x"].alias("xmin"), r["y"].alias("ymin"), (r["x"] + r["w"]).alias("xmax"), (r["y"] + r["h"]).alias("ymax"))


def area(r: Column) -> Column:
    return F.greatest(F.lit(0.0), r["w"]) * F.greatest(F.lit(0.0), r["h"])


def iou(a: Column, b: Column, clamp: bool = True) -> Column:
    """Intersection over union, 0 where the union is empty; ``clamp=False`` takes negative sizes as they are."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    inter = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    union = (area(a) + area(b) if clamp else a["w"] * a["h"] + b["w"] * b["h"]) - inter
    return F.when(union > 0 if clamp else union != 0, inter / union).otherwise(0.0)


def clamp_to_frame(r: Column, width: Column, height: Column) -> Column:
    x, y = F.greatest(F.lit(0.0), F.least(r["x"], width)), F.greatest(F.lit(0.0), F.least(r["y"], height))
    right, bottom = F.greatest(F.lit(0.0), F.least(r["x"] + r["w"], width)), F.greatest(F.lit(0.0), F.least(r["y"] + r["h"], height))
    return rect(x, y, F.greatest(F.lit(0.0), right - x), F.greatest(F.lit(0.0), bottom - y))


def pad_rect(r: Column, by: float | Column, width: Column, height: Column) -> Column:
    by = by if isinstance(by, Column) else F.lit(float(by))
    return clamp_to_frame(rect(r["x"] - by, r["y"] - by, r["w"] + by * 2, r["h"] + by * 2), width, height)


def scale(r: Column, by: Column) -> Column:
    return rect(r["x"] * by, r["y"] * by, r["w"] * by, r["h"] * by)


def shift(r: Column, dx: Column, dy: Column) -> Column:
    return rect(r["x"] + dx, r["y"] + dy, r["w"], r["h"])


def viewport_context(dpr: Column, scroll_x: Column, scroll_y: Column, width: Column, height: Column) -> Column:
    """The context conversions need; null where the pixel ratio isn't positive, so that such frames go to quarantine."""
    return F.when(dpr > 0, F.struct(dpr.alias("dpr"), F.coalesce(scroll_x, F.lit(0.0)).alias("scroll_x"), F.coalesce(scroll_y, F.lit(0.0)).alias("scroll_y"), width.alias("width"), height.alias("height")))


def css_to_capture(r: Column, dpr: Column) -> Column:
    return scale(r, dpr)


def capture_to_css(r: Column, dpr: Column) -> Column:
    return rect(r["x"] / dpr, r["y"] / dpr, r["w"] / dpr, r["h"] / dpr)


def viewport_to_document(r: Column, scroll_x: Column, scroll_y: Column) -> Column:
    return shift(r, scroll_x, scroll_y)


def document_to_viewport(r: Column, scroll_x: Column, scroll_y: Column) -> Column:
    return shift(r, -scroll_x, -scroll_y)


def child_to_parent(r: Column, frame: Column) -> Column:
    """A rect of a nested frame in its parent's space; ``frame`` is the nested frame's own rect there."""
    return shift(r, frame["x"], frame["y"])


def letterbox(width: Column, height: Column, size: float) -> Column:
    """The transform that fits a frame into a square of ``size``."""
    s = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    w, h = width * s, height * s
    return F.struct(s.alias("scale"), ((F.lit(float(size)) - w) / 2).alias("pad_x"), ((F.lit(float(size)) - h) / 2).alias("pad_y"), w.alias("draw_w"), h.alias("draw_h"), F.lit(float(size)).alias("size"), width.cast("double").alias("src_w"), height.cast("double").alias("src_h"))


def model_to_capture(r: Column, t: Column) -> Column:
    return rect((r["x"] - t["pad_x"]) / t["scale"], (r["y"] - t["pad_y"]) / t["scale"], r["w"] / t["scale"], r["h"] / t["scale"])


def capture_to_model(r: Column, t: Column) -> Column:
    return rect(r["x"] * t["scale"] + t["pad_x"], r["y"] * t["scale"] + t["pad_y"], r["w"] * t["scale"], r["h"] * t["scale"])


def normalized_to_pixels(r: Column, width: Column, height: Column) -> Column:
    return rect(r["x"] * width, r["y"] * height, r["w"] * width, r["h"] * height)


def looks_normalized(r: Column) -> Column:
    """Whether every part is at most 1.5; a frame is normalised if all of its boxes look so."""
    return (r["x"] <= 1.5) & (r["y"] <= 1.5) & (r["w"] <= 1.5) & (r["h"] <= 1.5)


def rect_problems(r: Column, width: Column, height: Column, min_size: float = 1.0) -> Column:
    """Why a mask can't be trusted: ``non-finite`` (alone), ``degenerate``, ``escapes``; empty if it can."""
    parts = [r[n] for n in "xywh"]
    bad = F.lit(False)
    for p in parts:
        bad = bad | p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    small = (r["w"] < min_size) | (r["h"] < min_size)
    out = (r["x"] < -0.01) | (r["y"] < -0.01) | (r["x"] + r["w"] > width + 0.01) | (r["y"] + r["h"] > height + 0.01)
    found = F.array_compact(F.array(F.when(small, F.lit("degenerate")), F.when(out, F.lit("escapes"))))
    return F.when(r.isNull() | bad, F.array(F.lit("non-finite"))).otherwise(found)


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def scaled_box(r: Column, image_w: Column, image_h: Column, viewport_w: Column, viewport_h: Column, least: int = 10) -> Column:
    """A CSS rect in whole pixels of an image of the viewport, no side below ``least``."""
    sx, sy = image_w / viewport_w, image_h / viewport_h
    return rect(round_half_up(r["x"] * sx), round_half_up(r["y"] * sy), F.greatest(round_half_up(r["w"] * sx), F.lit(least)), F.greatest(round_half_up(r["h"] * sy), F.lit(least)))


def face_proxy(person: Column, share: float = 0.3, least: float = 10.0) -> Column:
    """The upper part of a person's box, where the face is."""
    return rect(person["x"], person["y"], person["w"], F.greatest(person["h"] * share, F.lit(least)))


def blur_radius(r: Column) -> Column:
    return F.greatest(F.lit(12), F.floor(F.least(r["w"], r["h"]) / 4))


def centre_point(left: Column, top: Column, width: Column, height: Column) -> Column:
    return F.struct((left + width / 2).cast("int").alias("x"), (top + height / 2).cast("int").alias("y"))


def grid_points(r: Column, step: float) -> Column:
    """The points of a grid over a rect, from its upper left corner, right and lower edge open; none if it is empty."""
    axis = lambda start, size: F.when(size > 0, F.transform(F.sequence(F.lit(0), (F.ceil(size / step) - 1).cast("int")), lambda i: start + i * float(step))).otherwise(F.array().cast("array<double>"))
    return F.flatten(F.transform(axis(r["x"], r["w"]), lambda x: F.transform(axis(r["y"], r["h"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))
