import random

import pytest
from pyspark.sql import functions as F

from veilspark.functions import geometry as G
from veilspark.operators import evaluate, fusion

RECT = "STRUCT<x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>"
NAN = float("nan")


def lit(*r):
    return G.rect(*(F.lit(float(v)) for v in r))


@pytest.fixture
def value(spark):
    def get(c):
        v = spark.range(1).select(c.alias("v")).first().v
        return tuple(v) if hasattr(v, "asDict") else v

    return get


def test_boxes(value):
    assert value(G.iou(lit(0, 0, 10, 10), lit(0, 0, 10, 10))) == 1 and value(G.iou(lit(0, 0, 10, 10), lit(20, 0, 10, 10))) == 0
    assert value(G.iou(lit(0, 0, 10, 10), lit(5, 0, 10, 10))) == 50 / 150 and value(G.iou(lit(0, 0, 0, 0), lit(0, 0, 0, 0))) == 0
    w = F.lit(100.0)
    assert value(G.clamp_to_frame(lit(-10, -10, 50, 50), w, w)) == (0, 0, 40, 40) and value(G.clamp_to_frame(lit(80, 80, 50, 50), w, w)) == (80, 80, 20, 20)
    assert value(G.pad_rect(lit(0, 0, 10, 10), 4, w, w)) == (0, 0, 14, 14) and value(G.pad_rect(lit(50, 50, 10, 10), 4, w, w)) == (46, 46, 18, 18)
    t = G.letterbox(F.lit(1280.0), F.lit(720.0), 640)
    assert value(t)[:3] == (0.5, 0, 140) and value(G.letterbox(F.lit(720.0), F.lit(1280.0), 640))[1] == 140
    assert value(G.model_to_capture(G.capture_to_model(lit(10, 20, 30, 40), t), t)) == (10, 20, 30, 40)
    assert value(G.css_to_capture(lit(10, 20, 100, 40), F.lit(2.0))) == (20, 40, 200, 80)
    assert value(G.viewport_to_document(lit(10, 10, 50, 50), F.lit(120.0), F.lit(340.0))) == (130, 350, 50, 50)
    assert value(G.child_to_parent(lit(5, 5, 20, 10), lit(100, 200, 0, 0))) == (105, 205, 20, 10)
    assert value(G.face_proxy(lit(0, 0, 10, 100))) == (0, 0, 10, 30) and value(G.face_proxy(lit(0, 0, 10, 20))) == (0, 0, 10, 10)
    assert value(G.blur_radius(lit(0, 0, 100, 80))) == 20 and value(G.blur_radius(lit(0, 0, 4, 4))) == 12
    assert value(G.round_half_up(F.lit(-2.5))) == -2 and value(G.viewport_context(F.lit(0.0), F.lit(0.0), F.lit(0.0), w, w)) is None
    assert len(value(G.grid_points(lit(0, 0, 9, 4), 4))) == 3 and value(G.grid_points(lit(0, 0, 0, 4), 4)) == [] and value(G.grid_points(lit(0, 0, -4, 4), 4)) == []


@pytest.mark.parametrize("r, want", [((0, 0, 10, 10), []), ((0, 0, 0, 10), ["degenerate"]), ((90, 90, 50, 50), ["escapes"]), ((NAN, 0, 0, 1), ["non-finite"]), ((-1, 0, 0.5, 1), ["degenerate", "escapes"])])
def test_problems(value, r, want):
    assert value(G.rect_problems(lit(*r), F.lit(100.0), F.lit(100.0))) == want


def _boxes(spark, rows, extra):
    return spark.createDataFrame(rows, f"frame_id BIGINT, ord INT, rect {RECT}, {extra}")


def _dom(spark, rows):
    return _boxes(spark, [(f, o, r, "k", "L1", 1.0, "why") for f, o, r in rows], "kind STRING, layer STRING, confidence DOUBLE, reason STRING")


def _model(spark, rows):
    return _boxes(spark, [(f, o, r, lab, 0.9) for f, o, r, lab in rows], "label STRING, score DOUBLE")


def test_fusion(spark):
    dom = _dom(spark, [(1, 0, (100.0, 100.0, 200.0, 50.0)), (1, 1, (100.0, 100.0, 200.0, 50.0))])
    model = _model(spark, [(1, 0, (105.0, 102.0, 190.0, 48.0), "laptop"), (1, 1, (500.0, 500.0, 20.0, 20.0), "person"), (2, 0, (105.0, 102.0, 190.0, 48.0), "laptop"), (1, 2, None, "book"), (1, 3, (0.0, 0.0, 0.0, 5.0), "book")])
    m = {(r.frame_id, r.source, r.ord): r.style for r in fusion.merge_boxes(dom, model).collect()}
    assert m == {(1, "dom", 0): "solid", (1, "dom", 1): "solid", (1, "model", 1): "blur", (2, "model", 0): "solid", (1, "model", 2): "solid", (1, "model", 3): "solid"}
    assert fusion.merge_boxes(dom.limit(0), model).count() == 5 and fusion.merge_boxes(dom, model.limit(0)).count() == 2


def test_suppression_equals_brute_force(spark):
    r = random.Random(9)
    box = lambda: (r.uniform(-50, 300), r.uniform(-50, 300), r.choice((0.3, 1, 7, 40, 64, 100)) * r.uniform(0.5, 1.5), r.uniform(1, 120))
    dom = [(f, i, box()) for f in (1, 2) for i in range(120)]
    near = lambda b: tuple(v * r.uniform(0.85, 1.2) + r.uniform(-2, 2) * (k < 2) for k, v in enumerate(b))
    model = [(f, i, near(b), "book") for f, i, b in dom] + [(1, 1000 + i, box(), "book") for i in range(100)]

    def iou(a, b):
        w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        i = max(0, w) * max(0, h)
        return i / (a[2] * a[3] + b[2] * b[3] - i)

    want = {(f, o) for f, o, m, _ in model if any(g == f and iou(m, d) > 0.5 for g, _, d in dom)}
    got = {(x.frame_id, x.ord) for x in fusion.overlapping(_model(spark, model), _dom(spark, dom)).collect()}
    assert got == want and 20 < len(want) < len(model)
    with pytest.raises(ValueError):
        fusion.overlapping(_model(spark, model), _dom(spark, dom), 0.3)


def test_normalisation_is_per_frame(spark):
    s = "frame_id BIGINT, ord INT, label STRING, score DOUBLE, box STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE>"
    d = spark.createDataFrame([(1, 0, "face", 0.9, (10.0, 20.0, 60.0, 70.0)), (1, 1, "face", 0.9, (0.1, 0.1, 0.3, 0.3)), (2, 0, "face", 0.9, (0.1, 0.1, 0.3, 0.3)), (2, 1, "face", 0.34, (0.1, 0.1, 0.3, 0.3)), (2, 2, "chair", 0.9, (0.1, 0.1, 0.3, 0.3))], s)
    frames = spark.createDataFrame([(1, 1000.0, 1000.0, True), (2, 1000.0, 1000.0, True)], "frame_id BIGINT, width DOUBLE, height DOUBLE, vision_healthy BOOLEAN")
    out = {(r.frame_id, r.ord): tuple(round(v, 6) for v in r.rect) for r in fusion.normalize_detections(fusion.sensitive_detections(d), frames).collect()}
    assert out == {(1, 0): (10, 20, 50, 50), (1, 1): (0.1, 0.1, 0.2, 0.2), (2, 0): (100, 100, 200, 200)}


def test_gate_fails_closed(spark):
    frames = spark.createDataFrame([(1, 100.0, 100.0, True), (2, 100.0, 100.0, False), (3, 0.0, 100.0, True), (4, 100.0, 100.0, True), (5, 100.0, 100.0, None), (6, None, 100.0, True), (7, 100.0, 100.0, True), (8, 100.0, 100.0, True)], "frame_id BIGINT, width DOUBLE, height DOUBLE, vision_healthy BOOLEAN")
    masks = fusion.merge_boxes(_dom(spark, [(1, 0, (1.0, 1.0, 20.0, 20.0)), (4, 0, (NAN, 1.0, 2.0, 2.0)), (7, 0, None), (8, 0, (300.0, 1.0, 20.0, 20.0))]), _model(spark, []))
    state = {r.frame_id: (r.state, r.why) for r in fusion.gate_frames(frames, fusion.prepared_masks(masks, frames)).collect()}
    assert state == {1: ("released", None), 2: ("quarantine", "vision unhealthy"), 3: ("quarantine", "no size"), 4: ("quarantine", "bad masks"), 5: ("quarantine", "vision unhealthy"), 6: ("quarantine", "no size"), 7: ("quarantine", "bad masks"), 8: ("quarantine", "bad masks")}


def test_leak_rate(spark):
    truth = spark.createDataFrame([(1, (0.0, 0.0, 10.0, 10.0)), (2, (0.0, 0.0, 10.0, 10.0)), (3, (0.0, 0.0, 10.0, 10.0))], f"frame_id BIGINT, rect {RECT}")
    masks = spark.createDataFrame([(1, (0.0, 0.0, 600.0, 600.0)), (2, (0.0, 0.0, 5.0, 10.0)), (2, (0.0, 0.0, 5.0, 10.0)), (2, (0.0, 0.0, 0.0, 9.0))], f"frame_id BIGINT, rect {RECT}")
    assert {r.frame_id: (r.total, r.leak_rate) for r in fusion.leaked_points(truth, masks, step=1.0, cell=4.0).collect()} == {1: (100, 0.0), 2: (100, 0.5), 3: (100, 1.0)}


def test_leak_rate_on_the_fine_grid_within_the_frame(spark):
    frames = spark.createDataFrame([(1, 100.0, 100.0), (2, 100.0, 100.0), (3, 100.0, 100.0)], "frame_id BIGINT, width DOUBLE, height DOUBLE")
    truth = spark.createDataFrame([(1, (90.0, -10.0, 40.0, 20.0)), (2, (200.0, 0.0, 10.0, 10.0)), (3, (0.0, 0.0, 8.0, 4.0))], f"frame_id BIGINT, rect {RECT}")
    masks = spark.createDataFrame([(3, (0.0, 0.0, 4.0, 4.0))], f"frame_id BIGINT, rect {RECT}")
    got = {r.frame_id: (r.total, r.leaked, r.leak_rate) for r in fusion.leaked_points(truth, masks, frames=frames).collect()}
    assert got == {1: (9, 9, 1.0), 2: (0, 0, 0.0), 3: (2, 1, 0.5)}  # a strip of 4 px that a grid of 8 px steps over


def test_scores(spark):
    c = spark.createDataFrame([("a", 4, 1, 0), ("a", 0, 0, 0), ("b", 0, 0, 3), ("b", None, 2, None)], "k STRING, tp BIGINT, fp BIGINT, fn BIGINT")
    assert [(r.precision, r.recall, round(r.f1, 3)) for r in evaluate.per_case(c).collect()] == [(0.8, 1, 0.889), (1, 1, 1), (1, 0, 0), (0, 1, 0)]
    assert {r.k: (r.tp, r.fp, r.fn, r.precision) for r in evaluate.by(c, "k").collect()} == {"a": (4, 1, 0, 0.8), "b": (0, 2, 3, 0)}
    assert evaluate.by(c.limit(0)).first().cases == 0 and evaluate.by(c.limit(0), "k").count() == 0
    e = spark.createDataFrame([(True, True), (True, False), (False, False), (False, True)], "e BOOLEAN, f BOOLEAN")
    assert tuple(evaluate.confusion(e, "e", "f").first()) == (1, 1, 1, 1, 0.5, 0.5, 0.5) and evaluate.confusion(e.limit(0), "e", "f").first().precision == 0
    assert evaluate.differences(e, e.limit(0)).count() == 4 and evaluate.differences(e, e).count() == 0
