"""Queries of geometry, fusion and the release gate over boxes derived from elements and pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import fusion
from ..session import materialise
from .tables import table

_E = "SELECT DISTINCT page_id, ord, tag, type, rect FROM elements WHERE rect IS NOT NULL"
#: The inputs as SQL; the functions below say the same with columns.
_INPUTS = f"""WITH frames AS (SELECT page_id AS frame_id, CAST(1 + page_id % 3 AS DOUBLE) AS dpr, CAST(viewport_w * (1 + page_id % 3) AS DOUBLE) AS width, CAST(viewport_h * (1 + page_id % 3) AS DOUBLE) AS height, CAST(page_id % 50 AS DOUBLE) AS scroll_x, CAST(page_id % 400 AS DOUBLE) AS scroll_y, page_id % 10 <> 0 AS vision_healthy FROM page_index),
el AS ({_E}),
dom AS (SELECT e.page_id AS frame_id, e.ord, rect.x * dpr AS x, rect.y * dpr AS y, rect.w * dpr AS w, rect.h * dpr AS h, type AS kind FROM el e JOIN frames f ON e.page_id = f.frame_id WHERE type IN ('password', 'email', 'tel')),
raw AS (SELECT e.page_id AS frame_id, e.ord, CASE WHEN ord % 5 = 0 THEN 'person' WHEN ord % 5 = 1 THEN 'laptop' WHEN ord % 5 = 2 THEN 'chair' WHEN ord % 5 = 3 THEN 'book' ELSE 'face' END AS label, 0.25 + (ord % 15) * 0.05 AS score, rect.x * dpr + (ord % 7) AS xmin, rect.y * dpr + (ord % 3) AS ymin, rect.x * dpr + (ord % 7) + rect.w * dpr AS xmax, rect.y * dpr + (ord % 3) + rect.h * dpr AS ymax, width, height FROM el e JOIN frames f ON e.page_id = f.frame_id WHERE type IN ('password', 'email', 'tel', 'text', 'number') OR tag = 'td'),
det AS (SELECT frame_id, ord, label, score, CASE WHEN frame_id % 4 = 0 THEN xmin / width ELSE xmin END AS xmin, CASE WHEN frame_id % 4 = 0 THEN ymin / height ELSE ymin END AS ymin, CASE WHEN frame_id % 4 = 0 THEN xmax / width ELSE xmax END AS xmax, CASE WHEN frame_id % 4 = 0 THEN ymax / height ELSE ymax END AS ymax FROM raw),
sens AS (SELECT *, xmax - xmin AS w0, ymax - ymin AS h0 FROM det WHERE score >= 0.35 AND label IN ('person', 'face', 'head', 'cell phone', 'laptop', 'tv', 'book', 'id card')),
flag AS (SELECT frame_id, bool_and(xmin <= 1.5 AND ymin <= 1.5 AND w0 <= 1.5 AND h0 <= 1.5) AS norm FROM sens GROUP BY frame_id),
model AS (SELECT s.frame_id, s.ord, label, score, CASE WHEN norm THEN xmin * width ELSE xmin END AS x, CASE WHEN norm THEN ymin * height ELSE ymin END AS y, CASE WHEN norm THEN w0 * width ELSE w0 END AS w, CASE WHEN norm THEN h0 * height ELSE h0 END AS h FROM sens s JOIN flag USING (frame_id) JOIN frames USING (frame_id)),
kept AS (SELECT * FROM model m WHERE NOT EXISTS (SELECT 1 FROM dom d WHERE d.frame_id = m.frame_id AND {{iou_md}} > 0.5)),
masks AS (SELECT frame_id, ord, x, y, w, h, 'dom' AS source, kind, 'solid' AS style FROM dom UNION ALL SELECT frame_id, ord, x, y, w, h, 'model', label, CASE WHEN label IN ('person', 'face', 'head') THEN 'blur' ELSE 'solid' END FROM kept),
padded AS (SELECT frame_id, ord, source, kind, style, greatest(0, least(x - 3, width)) AS x, greatest(0, least(y - 3, height)) AS y, greatest(0, greatest(0, least(x - 3 + (w + 6), width)) - greatest(0, least(x - 3, width))) AS w, greatest(0, greatest(0, least(y - 3 + (h + 6), height)) - greatest(0, least(y - 3, height))) AS h, width, height FROM masks JOIN frames USING (frame_id))
"""


def _iou_sql(a: str, b: str) -> str:
    inter = f"(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"
    union = f"(greatest(0, {a}.w) * greatest(0, {a}.h) + greatest(0, {b}.w) * greatest(0, {b}.h) - {inter})"
    return f"(CASE WHEN {union} > 0 THEN {inter} / {union} ELSE 0.0 END)"


_INPUTS = _INPUTS.replace("{iou_md}", _iou_sql("m", "d"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    dpr = (1 + F.col("page_id") % 3).cast("double")
    return table(spark, d, "page_index").select(F.col("page_id").alias("frame_id"), dpr.alias("dpr"), (F.col("viewport_w") * dpr).alias("width"), (F.col("viewport_h") * dpr).alias("height"), (F.col("page_id") % 50).cast("double").alias("scroll_x"), (F.col("page_id") % 400).cast("double").alias("scroll_y"), (F.col("page_id") % 10 != 0).alias("vision_healthy"))


def _elements(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "elements").where("rect IS NOT NULL").select(F.col("page_id").alias("frame_id"), "ord", "tag", "type", "rect").distinct()


def dom_boxes(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d).where(F.col("type").isin("password", "email", "tel")).join(frames(spark, d), "frame_id")
    return e.select("frame_id", "ord", G.css_to_capture(F.col("rect"), F.col("dpr")).alias("rect"), F.col("type").alias("kind"), F.lit("L1").alias("layer"), F.lit(1.0).alias("confidence"), F.format_string('type="%s"', "type").alias("reason"))


def detections(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d).where(F.col("type").isin("password", "email", "tel", "text", "number") | (F.col("tag") == "td")).join(frames(spark, d), "frame_id")
    r, x, y = G.css_to_capture(F.col("rect"), F.col("dpr")), F.col("ord") % 7, F.col("ord") % 3
    label = F.element_at(F.array(*(F.lit(n) for n in ("person", "laptop", "chair", "book", "face"))), F.col("ord") % 5 + 1)
    part = lambda v, size: F.when(F.col("frame_id") % 4 == 0, v / F.col(size)).otherwise(v)
    box = F.struct(part(r["x"] + x, "width").alias("xmin"), part(r["y"] + y, "height").alias("ymin"), part(r["x"] + x + r["w"], "width").alias("xmax"), part(r["y"] + y + r["h"], "height").alias("ymax"))
    return e.select("frame_id", "ord", label.alias("label"), (F.lit(0.25) + (F.col("ord") % 15) * 0.05).alias("score"), box.alias("box"))


def _model(spark: SparkSession, d: str) -> DataFrame:
    return fusion.normalize_detections(fusion.sensitive_detections(detections(spark, d)), frames(spark, d))


def _masks(spark: SparkSession, d: str) -> DataFrame:
    """Both kinds of boxes are read several times on the way to the masks, so they are written once."""
    return fusion.merge_boxes(materialise(dom_boxes(spark, d), "dom-boxes"), materialise(_model(spark, d), "model-boxes"))


def _parts(r: Column, places: int = 6) -> list[Column]:
    """Sides rounded in a way that any engine with IEEE arithmetic repeats."""
    k = float(10**places)
    return [(F.floor(r[n] * k + 0.5) / k).alias(n) for n in "xywh"]


def frame_boxes(spark: SparkSession, d: str) -> DataFrame:
    return dom_boxes(spark, d).select("frame_id", "ord", "kind", *_parts(F.col("rect")))


def sensitive_classes(spark: SparkSession, d: str) -> DataFrame:
    return fusion.sensitive_detections(detections(spark, d)).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def normalized_detections(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d).select("frame_id", "ord", "label", *_parts(F.col("rect"), 4))


def merged_masks(spark: SparkSession, d: str) -> DataFrame:
    return _masks(spark, d).select("frame_id", "ord", "source", "kind", "style", *_parts(F.col("rect"), 4))


def padded_masks(spark: SparkSession, d: str) -> DataFrame:
    p = fusion.prepared_masks(_masks(spark, d), frames(spark, d))
    return p.select("frame_id", "ord", "source", "paint_order", F.array_join("problems", ",").alias("problems"), F.col("blur_radius").cast("bigint").alias("blur_radius"), *_parts(F.col("padded"), 4))


def release_quarantine(spark: SparkSession, d: str) -> DataFrame:
    prepared = fusion.prepared_masks(_masks(spark, d), frames(spark, d))
    return fusion.gate_frames(frames(spark, d), prepared).select("frame_id", "masks", "bad_masks", "state", "why")


def leaked_pixel_rate(spark: SparkSession, d: str) -> DataFrame:
    """On a coarse grid of 8 px, of boxes as they are; ``leaked_pixel_rate_4px`` has the reference's grid and clamps."""
    truth, masks = dom_boxes(spark, d), _model(spark, d)
    return fusion.leaked_points(truth.select("frame_id", "rect"), masks.select("frame_id", "rect"), step=8.0).select("frame_id", "total", "leaked", F.round("leak_rate", 9).alias("leak_rate"))


def leaked_pixel_rate_4px(spark: SparkSession, d: str) -> DataFrame:
    """On the reference's grid of 4 px, true boxes clamped to their frame; one row for every frame."""
    truth, masks = dom_boxes(spark, d), _model(spark, d)
    return fusion.leaked_points(truth.select("frame_id", "rect"), masks.select("frame_id", "rect"), frames=frames(spark, d)).select("frame_id", "total", "leaked", F.round("leak_rate", 9).alias("leak_rate"))


def mask_manifest(spark: SparkSession, d: str) -> DataFrame:
    m = fusion.manifest(dom_boxes(spark, d).withColumn("source", F.lit("dom")))
    return m.select("frame_id", "label", *(F.col("box")[i].alias(n) for i, n in enumerate("xywh")))


def first_masks(spark: SparkSession, d: str) -> DataFrame:
    return fusion.top_masks(_masks(spark, d)).select("frame_id", "ord", "source", F.col("place").cast("bigint").alias("place"))


def earlier_policy_masks(spark: SparkSession, d: str) -> DataFrame:
    m = fusion.earlier_masks(dom_boxes(spark, d), _model(spark, d).where("score >= 0.5"))
    return m.groupBy("source", "label").agg(F.count("*").alias("n"), F.round(F.sum(F.col("rect.h")), 3).alias("heights"))


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d).select("frame_id", "ord", "rect")
    return e.join(e.select("frame_id", (F.col("ord") - 1).alias("ord"), F.col("rect").alias("next")), ["frame_id", "ord"])


def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).select("frame_id", "ord", F.round(G.iou(F.col("rect"), F.col("next")), 9).alias("iou"), F.round(G.area(F.col("rect")), 6).alias("area"))


def coord_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Largest deviation of a rect after a trip through each pair of conversions, over all elements."""
    e = _elements(spark, d).join(frames(spark, d), "frame_id")
    t = G.letterbox(F.col("width"), F.col("height"), 640)
    r = F.col("rect")
    trips = {
        "capture": G.capture_to_css(G.css_to_capture(r, F.col("dpr")), F.col("dpr")),
        "document": G.document_to_viewport(G.viewport_to_document(r, F.col("scroll_x"), F.col("scroll_y")), F.col("scroll_x"), F.col("scroll_y")),
        "model": G.model_to_capture(G.capture_to_model(r, t), t),
        "corners": G.from_corners(G.to_corners(r)),
        "array": G.from_array(G.to_array(r)),
    }
    off = lambda q: F.greatest(*(F.abs(q[n] - r[n]) for n in "xywh"))
    return e.agg(F.count("*").alias("n"), *(F.round(F.max(off(q)), 6).alias(name) for name, q in trips.items()))


def letterboxes(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("frame_id", G.letterbox(F.col("width"), F.col("height"), 640).alias("t")).select("frame_id", *(F.round(f"t.{n}", 6).alias(n) for n in ("scale", "pad_x", "pad_y", "draw_w", "draw_h")))


def scaled_boxes(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d).join(frames(spark, d), "frame_id")
    b = G.scaled_box(F.col("rect"), F.col("width"), F.col("height"), F.col("width") / F.col("dpr"), F.col("height") / F.col("dpr"))
    c = G.centre_point(b["x"], b["y"], b["w"], b["h"])
    return e.select("frame_id", "ord", *_parts(b), c["x"].alias("cx"), c["y"].alias("cy"))


def child_frames(spark: SparkSession, d: str) -> DataFrame:
    """Rects of each frame's elements as if the frame were nested in a parent at (100, 200)."""
    at = G.rect(F.lit(100), F.lit(200), F.lit(0), F.lit(0))
    return _elements(spark, d).select("frame_id", "ord", *_parts(G.child_to_parent(F.col("rect"), at)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (frame_boxes, sensitive_classes, normalized_detections, merged_masks, padded_masks, release_quarantine, leaked_pixel_rate, leaked_pixel_rate_4px, mask_manifest, first_masks, earlier_policy_masks, iou_pairs, coord_roundtrip, letterboxes, scaled_boxes, child_frames)
}
_R = lambda n, places=6: ", ".join(f"floor({c} * {float(10**places)} + 0.5) / {float(10**places)} AS {c}" for c in n)
_BAD = "(w < 1 OR h < 1)"
_OUT = "(x < -0.01 OR y < -0.01 OR x + w > width + 0.01 OR y + h > height + 0.01)"
_PAIRS = f"WITH e AS (SELECT page_id AS frame_id, ord, rect.x AS x, rect.y AS y, rect.w AS w, rect.h AS h FROM ({_E}))"
SQL: dict[str, str] = {
    "frame_boxes": _INPUTS + f"SELECT frame_id, ord, kind, {_R('xywh')} FROM dom",
    "sensitive_classes": _INPUTS + "SELECT label, count(*) AS n, round(avg(score), 6) AS mean_score FROM sens GROUP BY label",
    "normalized_detections": _INPUTS + f"SELECT frame_id, ord, label, {_R('xywh', 4)} FROM model",
    "merged_masks": _INPUTS + f"SELECT frame_id, ord, source, kind, style, {_R('xywh', 4)} FROM masks",
    "padded_masks": _INPUTS + f"SELECT frame_id, ord, source, CASE WHEN style = 'blur' THEN 0 ELSE 1 END AS paint_order, concat_ws(',', CASE WHEN {_BAD} THEN 'degenerate' END, CASE WHEN {_OUT} THEN 'escapes' END) AS problems, CASE WHEN style = 'blur' THEN CAST(greatest(12, floor(least(w, h) / 4)) AS BIGINT) END AS blur_radius, {_R('xywh', 4)} FROM padded",
    "release_quarantine": _INPUTS + f"SELECT frame_id, coalesce(n, 0) AS masks, coalesce(bad, 0) AS bad_masks, CASE WHEN why IS NULL THEN 'released' ELSE 'quarantine' END AS state, why FROM (SELECT f.frame_id, n, bad, CASE WHEN NOT vision_healthy THEN 'vision unhealthy' WHEN NOT (width > 0 AND height > 0) THEN 'no size' WHEN bad > 0 THEN 'bad masks' END AS why FROM frames f LEFT JOIN (SELECT frame_id, count(*) AS n, CAST(count_if({_BAD} OR {_OUT}) AS BIGINT) AS bad FROM padded GROUP BY frame_id) m USING (frame_id))",
    "leaked_pixel_rate": _INPUTS + """, px AS (SELECT frame_id, x, y, w, h, x + i * 8.0 AS px FROM (SELECT *, unnest(range(CAST(ceil(w / 8.0) AS BIGINT))) AS i FROM dom WHERE w > 0 AND h > 0)),
pts AS (SELECT frame_id, px, y + i * 8.0 AS py FROM (SELECT *, unnest(range(CAST(ceil(h / 8.0) AS BIGINT))) AS i FROM px)),
j AS (SELECT frame_id, EXISTS (SELECT 1 FROM model m WHERE m.frame_id = p.frame_id AND px >= m.x AND px < m.x + m.w AND py >= m.y AND py < m.y + m.h) AS covered FROM pts p)
SELECT frame_id, count(*) AS total, CAST(count_if(NOT covered) AS BIGINT) AS leaked, round(count_if(NOT covered) / count(*), 9) AS leak_rate FROM j GROUP BY frame_id""",
    "leaked_pixel_rate_4px": _INPUTS + """, truth AS (SELECT frame_id, greatest(0, least(x, width)) AS x, greatest(0, least(y, height)) AS y, greatest(0, least(x + w, width)) AS x2, greatest(0, least(y + h, height)) AS y2 FROM dom JOIN frames USING (frame_id)),
px AS (SELECT frame_id, y, y2, x + i * 4.0 AS px FROM (SELECT *, unnest(range(CAST(ceil((x2 - x) / 4.0) AS BIGINT))) AS i FROM truth WHERE x2 > x AND y2 > y)),
pts AS (SELECT frame_id, px, y + i * 4.0 AS py FROM (SELECT *, unnest(range(CAST(ceil((y2 - y) / 4.0) AS BIGINT))) AS i FROM px)),
j AS (SELECT frame_id, EXISTS (SELECT 1 FROM model m WHERE m.frame_id = p.frame_id AND px >= m.x AND px < m.x + m.w AND py >= m.y AND py < m.y + m.h) AS covered FROM pts p),
c AS (SELECT frame_id, count(*) AS total, CAST(count_if(NOT covered) AS BIGINT) AS leaked FROM j GROUP BY frame_id)
SELECT frame_id, coalesce(total, 0) AS total, coalesce(leaked, 0) AS leaked, coalesce(round(leaked / total, 9), 0.0) AS leak_rate FROM frames LEFT JOIN c USING (frame_id)""",
    "mask_manifest": _INPUTS + "SELECT frame_id, kind AS label, " + ", ".join(f"CAST(floor({c} + 0.5) AS INT) AS {c}" for c in "xywh") + " FROM dom",
    "first_masks": _INPUTS + "SELECT frame_id, ord, source, place FROM (SELECT frame_id, ord, source, row_number() OVER (PARTITION BY frame_id ORDER BY CASE WHEN source = 'dom' THEN 0 ELSE 1 END, ord) AS place FROM masks) WHERE place <= 40",
    "earlier_policy_masks": _INPUTS + "SELECT source, label, count(*) AS n, round(sum(hh), 3) AS heights FROM (SELECT 'DOM' AS source, kind AS label, h AS hh FROM dom UNION ALL SELECT CASE WHEN label = 'person' THEN 'VISION_FACE_PROXY' ELSE 'VISION_OBJECT' END, label, CASE WHEN label = 'person' THEN greatest(h * 0.3, 10) ELSE h END FROM model WHERE score >= 0.5 AND label IN ('person', 'cell phone', 'laptop', 'book')) GROUP BY ALL",
    "iou_pairs": _PAIRS + f" SELECT e.frame_id, e.ord, round({_iou_sql('e', 'n')}, 9) AS iou, round(greatest(0, e.w) * greatest(0, e.h), 6) AS area FROM e JOIN e n ON n.frame_id = e.frame_id AND n.ord = e.ord + 1",
    "coord_roundtrip": _INPUTS + "SELECT count(*) AS n, 0.0 AS capture, 0.0 AS document, 0.0 AS model, 0.0 AS corners, 0.0 AS array FROM el JOIN frames ON page_id = frame_id",
    "letterboxes": _INPUTS + "SELECT frame_id, round(s, 6) AS scale, round((640 - width * s) / 2, 6) AS pad_x, round((640 - height * s) / 2, 6) AS pad_y, round(width * s, 6) AS draw_w, round(height * s, 6) AS draw_h FROM (SELECT *, least(640 / width, 640 / height) AS s FROM frames)",
    "scaled_boxes": _INPUTS + "SELECT frame_id, ord, x, y, w, h, CAST(trunc(x + w / 2) AS INT) AS cx, CAST(trunc(y + h / 2) AS INT) AS cy FROM (SELECT page_id AS frame_id, ord, floor(rect.x * (width / (width / dpr)) + 0.5) AS x, floor(rect.y * (height / (height / dpr)) + 0.5) AS y, greatest(floor(rect.w * (width / (width / dpr)) + 0.5), 10) AS w, greatest(floor(rect.h * (height / (height / dpr)) + 0.5), 10) AS h FROM el JOIN frames ON page_id = frame_id)",
    "child_frames": _INPUTS + "SELECT page_id AS frame_id, ord, rect.x + 100 AS x, rect.y + 200 AS y, rect.w AS w, rect.h AS h FROM el",
}
