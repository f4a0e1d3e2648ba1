"""Boxes of several detectors into masks, and the gate that releases or withholds a frame.

``dom``: frame_id, ord, rect, kind, layer, confidence, reason (capture pixels).
``detections``: frame_id, ord, label, score, box (corners). ``frames``: frame_id,
width, height, vision_healthy.

Defined results: a frame without masks is released if its vision is healthy and
its size is positive; null rects and non-finite numbers withhold their frame;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.patterns import BLURRED_CLASSES, SENSITIVE_CLASSES


def sensitive_detections(detections: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Detections of sensitive classes with a score of at least ``threshold``."""
    return detections.where((F.col("score") >= threshold) & F.col("label").isin(*SENSITIVE_CLASSES))


def normalize_detections(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """Corner boxes as rects in capture pixels; whether a frame's boxes are shares of it is decided per frame."""
    r = detections.withColumn("rect", G.from_corners(F.col("box"))).drop("box")
    flags = r.groupBy("frame_id").agg(F.bool_and(G.looks_normalized(F.col("rect"))).alias("_norm"))
    j = r.join(flags, "frame_id").join(frames.select("frame_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "frame_id")
    return j.withColumn("rect", F.when(F.col("_norm"), G.normalized_to_pixels(F.col("rect"), F.col("_w"), F.col("_h"))).otherwise(F.col("rect"))).drop("_norm", "_w", "_h")


def _level(size: Column) -> Column:
    return F.floor(F.log2(size)).cast("int")


def overlapping(model: DataFrame, dom: DataFrame, above: float = 0.5) -> DataFrame:
    """(frame_id, ord) of model boxes whose IoU with a DOM box of their frame is above ``above`` (0.5 or more).

    Two boxes with an IoU above one half hold each other's centre and differ
    by less than twice in width and in height. So a DOM box is put into one
    cell of a grid as fine as its own size, a model box looks into the cells
    near its centre on its own and the adjacent grids, and the join is an
    equi-join on frame and cell, however many boxes one frame has.
    """
    if above < 0.5:
        raise ValueError("the grid is exact for an IoU above one half")
    sized = F.col("rect.w").isNotNull() & (F.col("rect.w") > 0) & (F.col("rect.h") > 0)
    cx, cy = F.col("rect.x") + F.col("rect.w") / 2, F.col("rect.y") + F.col("rect.h") / 2
    cell = lambda c, level: F.floor(c / F.pow(F.lit(2.0), level)).cast("bigint")
    d = dom.where(sized).select("frame_id", F.col("rect").alias("_d"), _level(F.col("rect.w")).alias("_lx"), _level(F.col("rect.h")).alias("_ly"), cell(cx, _level(F.col("rect.w"))).alias("_cx"), cell(cy, _level(F.col("rect.h"))).alias("_cy"))

    def reach(centre: Column, size: Column) -> Column:
        def at(level: Column) -> Column:
            near = F.least(size, F.pow(F.lit(2.0), level + 1)) / 2
            return F.transform(F.sequence(cell(centre - near, level), cell(centre + near, level)), lambda c: F.struct(level.alias("l"), c.alias("c")))

        return F.flatten(F.transform(F.sequence(_level(size) - 1, _level(size) + 1), at))

    m = model.where(sized).select("frame_id", "ord", F.col("rect").alias("_m"), F.explode(reach(cx, F.col("rect.w"))).alias("_x"), reach(cy, F.col("rect.h")).alias("_ys")).withColumn("_y", F.explode("_ys"))
    m = m.select("frame_id", "ord", "_m", F.col("_x.l").alias("_lx"), F.col("_x.c").alias("_cx"), F.col("_y.l").alias("_ly"), F.col("_y.c").alias("_cy"))
    hit = m.join(d, ["frame_id", "_lx", "_ly", "_cx", "_cy"]).where(G.iou(F.col("_m"), F.col("_d")) > above)
    return hit.select("frame_id", "ord").distinct()


def merge_boxes(dom: DataFrame, model: DataFrame, above: float = 0.5) -> DataFrame:
    """All DOM boxes, and the model boxes that no DOM box covers, as masks."""
    kept = model.join(overlapping(model, dom, above), ["frame_id", "ord"], "left_anti")
    style = F.when(F.col("label").isin(*BLURRED_CLASSES), "blur").otherwise("solid")
    a = dom.select("frame_id", "ord", "rect", F.lit("dom").alias("source"), "kind", "layer", "confidence", "reason", F.lit("solid").alias("style"))
    b = kept.select("frame_id", "ord", "rect", F.lit("model").alias("source"), F.col("label").alias("kind"), F.lit("V1").alias("layer"), F.col("score").alias("confidence"), F.format_string("vision: %s @ %d%%", F.col("label"), G.round_half_up(F.col("score") * 100).cast("int")).alias("reason"), style.alias("style"))
    return a.unionByName(b)


def earlier_masks(dom: DataFrame, model: DataFrame) -> DataFrame:
    """The earlier policy: persons become face proxies, few objects stay boxes, nothing is suppressed."""
    object_box = F.col("label").isin("cell phone", "laptop", "book")
    b = model.where((F.col("label") == "person") | object_box)
    r = F.when(F.col("label") == "person", G.face_proxy(F.col("rect"))).otherwise(F.col("rect"))
    source = F.when(F.col("label") == "person", "VISION_FACE_PROXY").otherwise("VISION_OBJECT")
    return dom.select("frame_id", F.lit("DOM").alias("source"), F.col("kind").alias("label"), "rect", F.lit(None).cast("double").alias("score")).unionByName(b.select("frame_id", source.alias("source"), "label", r.alias("rect"), "score"))


def prepared_masks(masks: DataFrame, frames: DataFrame, pad: float = 3.0) -> DataFrame:
    """Masks padded within their frame, with the problems they had before (non-finite) or have now, and their painting order."""
    j = masks.join(frames.select("frame_id", F.col("width").cast("double").alias("_w"), F.col("height").cast("double").alias("_h")), "frame_id")
    raw = G.rect_problems(F.col("rect"), F.col("_w"), F.col("_h"))
    non_finite = F.array_contains(raw, "non-finite")
    padded = F.when(~non_finite, G.pad_rect(F.col("rect"), pad, F.col("_w"), F.col("_h")))
    j = j.withColumn("padded", padded).withColumn("problems", F.when(non_finite, raw).otherwise(G.rect_problems(F.col("padded"), F.col("_w"), F.col("_h"))))
    return j.withColumn("paint_order", F.when(F.col("style") == "blur", 0).otherwise(1)).withColumn("blur_radius", F.when(F.col("style") == "blur", G.blur_radius(F.col("padded")))).drop("_w", "_h")


def gate_frames(frames: DataFrame, prepared: DataFrame, policy: str = "closed") -> DataFrame:
    """Fail closed: a frame is ``released`` only if its vision ran, it has a size and all of its masks are sound.

    ``policy="v1"`` is the earlier one, for comparison only: every frame goes out, whatever failed (``why`` still says what did).
    """
    if policy not in ("closed", "v1"):
        raise ValueError(f"unknown policy {policy!r}; there are closed and v1")
    m = prepared.groupBy("frame_id").agg(F.count("*").alias("masks"), F.count_if(F.size("problems") > 0).alias("bad_masks"))
    j = frames.join(m, "frame_id", "left").fillna(0, ["masks", "bad_masks"])
    why = F.when(~F.coalesce(F.col("vision_healthy"), F.lit(False)), "vision unhealthy").when(~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)), "no size").when(F.col("bad_masks") > 0, "bad masks")
    return j.select("frame_id", "masks", "bad_masks", why.alias("why")).withColumn("state", F.when(F.col("why").isNull() | F.lit(policy == "v1"), "released").otherwise("quarantine"))


def leaked_points(truth: DataFrame, masks: DataFrame, step: float = 4.0, cell: float = 256.0, frames: DataFrame | None = None) -> DataFrame:
    """(frame_id, total, leaked, leak_rate): grid points of the true boxes that no mask of their frame covers.

    With ``frames`` (frame_id, width, height) the true boxes are clamped to their frame, and
    every frame has a row: without a point its total and rate are 0.

    A range anti-join on cells: masks are listed in every cell they touch,
    points look into their own. Masks hold their upper left edge, not their lower right.
    """
    if frames is not None:
        truth = truth.join(frames.select("frame_id", "width", "height"), "frame_id").select("frame_id", G.clamp_to_frame(F.col("rect"), F.col("width"), F.col("height")).alias("rect"))
    p = truth.select("frame_id", F.explode(G.grid_points(F.col("rect"), step)).alias("p")).select("frame_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    p = p.withColumn("_cx", F.floor(F.col("px") / cell)).withColumn("_cy", F.floor(F.col("py") / cell))
    cells = lambda a, n: F.explode(F.sequence(F.floor(F.col(f"rect.{a}") / cell), F.floor((F.col(f"rect.{a}") + F.col(f"rect.{n}")) / cell)))
    m = masks.where("rect.w > 0 AND rect.h > 0").select("frame_id", "rect", cells("x", "w").alias("_cx")).withColumn("_cy", cells("y", "h"))
    inside = (F.col("px") >= F.col("m.rect.x")) & (F.col("px") < F.col("m.rect.x") + F.col("m.rect.w")) & (F.col("py") >= F.col("m.rect.y")) & (F.col("py") < F.col("m.rect.y") + F.col("m.rect.h"))
    same = (F.col("p.frame_id") == F.col("m.frame_id")) & (F.col("p._cx") == F.col("m._cx")) & (F.col("p._cy") == F.col("m._cy"))
    leaked = p.alias("p").join(m.alias("m"), same & inside, "left_anti").groupBy("frame_id").agg(F.count("*").alias("leaked"))
    along = lambda n: F.ceil(F.col(f"rect.{n}") / step).cast("bigint")
    points = F.when((F.col("rect.w") > 0) & (F.col("rect.h") > 0), along("w") * along("h"))
    total = truth.groupBy("frame_id").agg(F.sum(points).alias("total")).where("total > 0")  # counted, not listed
    if frames is not None:
        total = frames.select("frame_id").distinct().join(total, "frame_id", "left").fillna(0, ["total"])
    return total.join(leaked, "frame_id", "left").fillna(0, ["leaked"]).withColumn("leak_rate", F.coalesce(F.try_divide("leaked", "total"), F.lit(0.0)))


def attach_scans(frames: DataFrame, **scans: DataFrame) -> DataFrame:
    """Frames with what each scan found, as one struct column a scan, joined by ``frame_id`` and not by the order of calls; null where a scan has nothing. Scans have one row a frame."""
    for name, scan in scans.items():
        columns = [c for c in scan.columns if c != "frame_id"]
        frames = frames.join(scan.select("frame_id", F.struct(*columns).alias(name)), "frame_id", "left")
    return frames


def top_masks(masks: DataFrame, n: int = 40) -> DataFrame:
    """The first ``n`` masks of each frame, DOM boxes first."""
    w = Window.partitionBy("frame_id").orderBy(F.when(F.col("source") == "dom", 0).otherwise(1), "ord")
    return masks.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def manifest(masks: DataFrame) -> DataFrame:
    """What leaves with a frame: source, label and whole-pixel box of each mask."""
    return masks.select("frame_id", "source", F.col("kind").alias("label"), F.transform(G.to_array(F.col("rect")), lambda v: G.round_half_up(v).cast("int")).alias("box"))
