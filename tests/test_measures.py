import json
import os
import random

import pytest

from veilspark.operators import measures
from veilspark.plans import corpus

REQUESTS = "request_id BIGINT, client STRING, capture_note STRING, viewport MAP<STRING, DOUBLE>, dom_elements ARRAY<STRUCT<rect: STRUCT<left: DOUBLE, top: DOUBLE, width: DOUBLE, height: DOUBLE>>>, redaction_manifest ARRAY<STRUCT<box: ARRAY<INT>>>, units STRING, view STRING"
CLIENTS = "client STRING, rect_unit STRING, box_unit STRING, viewport_unit STRING"


def _clients(spark):
    return spark.createDataFrame([("a", "mm", "device px", "in"), ("b", None, None, None), ("c", "% of viewport", "px (CSS)", "device px"), ("c", "% of viewport", "px (CSS)", "device px")], CLIENTS)


def _placed(df):
    return {(r.kind, r.path): tuple(round(v, 6) for v in r[3:]) for r in df.collect()}


def test_precedence_and_contexts(spark):
    r = [(1, "a", None, {"width": 10.0, "h": 5.0, "dpr": 2.0}, [((25.4, 0.0, 50.8, 25.4),), None, (None,)], [([10, 20, 30, 40],), (None,), ([1, 2, 3],)], "x", "y")]
    assert _placed(measures.place_requests(spark.createDataFrame(r, REQUESTS), _clients(spark))) == {("rect", "0"): (96, 0, 192, 96), ("box", "0"): (5, 10, 15, 20)}
    r = [(1, "a", "rects: rem; boxes in 0.01 % of viewport", {"w": 10.0, "innerHeight": 5.0}, [((1.0, 1.0, 2.0, 2.0),)], [([1000, 1000, 10000, 5000],)], None, None)]
    assert _placed(measures.place_requests(spark.createDataFrame(r, REQUESTS), _clients(spark))) == {("rect", "0"): (16, 16, 32, 32), ("box", "0"): (96, 48, 960, 240)}
    r = [(1, "c", None, {"width": 800.0, "height": 400.0, "devicePixelRatio": 2.0}, [((50.0, 50.0, 10.0, 10.0),)], None, None, None)]
    assert _placed(measures.place_requests(spark.createDataFrame(r, REQUESTS), _clients(spark))) == {("rect", "0"): (200, 100, 40, 20)}


def test_no_unit_no_view_no_row(spark):
    r = [(1, "b", None, None, [((1.0, 1.0, 1.0, 1.0),)], [([1, 2, 3, 4],)], None, None), (2, None, None, None, None, None, None, None), (3, "c", None, None, [((1.0, 1.0, 1.0, 1.0),)], None, None, None), (4, "a", None, {}, [((float("nan"), 1.0, 1.0, 1.0),), ((None, 1.0, 1.0, 1.0),)], [], None, None)]
    assert _placed(measures.place_requests(spark.createDataFrame(r, REQUESTS), _clients(spark))) == {}
    assert measures.place_requests(spark.createDataFrame([], REQUESTS), _clients(spark)).count() == 0


def test_bodies():
    units = {"rect": "mm", "box": None, "viewport": None}
    body = {"viewport": "400px x 200px @2x", "units": {"box": "device px"}, "dom_elements": [{"rect": "left: 1in; top: 2 in; width: 25.4mm; height: 72pt"}, {"rect": [25.4, 0, 25.4, 0]}, {"rect": {"x": 1, "y": 1, "w": 1, "h": 1, "unit": "rem"}}, {"rect": "junk"}, {"rect": {}}], "redaction_manifest": [{"box": [2, 4, 6, 8]}, {"box": ["1px", "2px", "3px", "4px"], "unit": "in"}, {"box": {"x": 10, "y": 10, "w": 10, "h": 10}, "unit": "% of viewport"}, {"box": [1, 2]}, {"box": None}]}
    found = {(k, p): [round(v, 6) for v in rest] for k, p, *rest in measures.place_body(json.dumps(body), units)}
    assert found == {("rect", "0"): [96, 192, 96, 96], ("rect", "1"): [96, 0, 96, 0], ("rect", "2"): [16] * 4, ("box", "0"): [1, 2, 3, 4], ("box", "1"): [1, 2, 3, 4], ("box", "2"): [40, 20, 40, 20]}
    assert list(measures.place_body(None, {})) == [] and list(measures.place_body("{", {})) == []
    sized = {"viewport": {"size": [10, "300px"], "dpr": "2"}, "units": {"viewport": "in", "rect": "fraction of viewport"}, "dom_elements": {"rect": [0.5, 0.5, 0.1, 0.1]}}
    assert [round(v, 6) for v in next(iter(measures.place_body(json.dumps(sized), {})))[2:]] == [480, 150, 96, 30]


def test_viewports(spark, tmp_path):
    r = [(1, "a", None, {"width": 10.0, "h": 5.0}, None, None, None, None), (2, "b", "viewport in device px", {"w": 800.0, "dpr": 2.0}, None, None, None, None), (3, "a", None, {"width": float("nan"), "dpr": 2.0}, None, None, None, None), (4, "b", None, None, None, None, None, None), (5, "b", None, {"width": 8.0, "height": 8.0}, None, None, None, None)]
    got = measures.place_requests(spark.createDataFrame(r, REQUESTS), _clients(spark), viewports=True).collect()
    assert sorted((tuple(x) for x in got), key=str) == [(1, "viewport", "", None, None, 960.0, 480.0), (2, "viewport", "", None, None, 400.0, None)]
    units = {"viewport": "in"}
    bodies = [{"viewport": "400px x 2in @2x"}, {"viewport": {"w": 10, "h": None}}, {"viewport": [800, 400], "units": {"viewport": "device px"}}, {"viewport": None, "task": "t"}, {"viewport": "wide"}]
    assert [list(measures.place_body(json.dumps(b), units, viewports=True)) for b in bodies] == [[("viewport", "", None, None, 400, 192)], [("viewport", "", None, None, 960, None)], [("viewport", "", None, None, 800, 400)], [], []]
    assert list(measures.place_body(json.dumps(bodies[0]), units)) == []
    p = spark.createDataFrame([(9, "a", json.dumps(bodies[0]))], "request_id BIGINT, client STRING, body STRING")
    assert [tuple(x) for x in measures.place_bodies(p, _clients(spark), viewports=True).collect()] == [(9, "viewport", "", None, None, 400.0, 192.0)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data here")
def test_placed_query_has_viewports_of_both_inputs(spark):
    placed = corpus.p1_placed(spark, "/root/testdata/sf0.001").where("kind = 'viewport'")
    for name in ("requests", "act_payloads"):
        assert placed.join(spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").select("request_id"), "request_id", "left_semi").count() > 0


def test_band_join_equals_brute_force(spark):
    r = random.Random(3)
    rows = []
    for q in range(3):
        for i in range(150 if q else 600):  # one request holds most of the rows
            base = [r.uniform(0, 60), r.uniform(0, 60), 20.0, 20.0]
            rows.append((q, "rect", str(i), *base))
            rows.append((q, "box", str(i), *(v + r.choice((-3, -2, -1.99, 0, 2, 2.01)) for v in base)))
    df = spark.createDataFrame(rows + rows[:50], measures.PLACED)
    want = {(a[0], a[2], b[2]) for a in rows if a[1] == "box" for b in rows if b[1] == "rect" and a[0] == b[0] and all(abs(x - y) <= 2 + 1e-6 for x, y in zip(a[3:], b[3:]))}
    got = [tuple(x) for x in measures.matching_boxes(df).collect()]
    assert set(got) == want and len(got) == len(want)
    assert measures.matching_boxes(df.limit(0)).count() == 0
