from datetime import datetime

import pytest
from pyspark.sql import functions as F

from veilspark.functions import elements as E
from veilspark.operators import actions, digest

SCHEMA = "page_id BIGINT, ord INT, tag STRING, type STRING, name STRING, id STRING, placeholder STRING, aria_label STRING, data_testid STRING, data_test STRING, aria_labelledby STRING, autocomplete STRING, role STRING, href STRING, value STRING, text STRING, rect STRUCT<x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>, hidden BOOLEAN, loaded_at TIMESTAMP, haystack STRING"
BOX = (10.0, 10.0, 100.0, 20.0)


def element(ord, tag="input", **kw):
    row = {"page_id": 1, "ord": ord, "tag": tag, "type": None, "name": None, "id": None, "placeholder": None, "aria_label": None, "data_testid": None, "data_test": None, "aria_labelledby": None, "autocomplete": None, "role": None, "href": None, "value": None, "text": None, "rect": BOX, "hidden": None, "loaded_at": datetime(2025, 1, 1), "haystack": "clash"}
    return tuple({**row, **kw}.values())


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def pages(spark, *ids):
    return spark.createDataFrame([(i, f"https://x.example/{i}?m=a@b.com", None, 800, 600) for i in ids or (1,)], "page_id BIGINT, url STRING, page_title STRING, viewport_w INT, viewport_h INT")


@pytest.mark.parametrize(
    "attributes, layer, kind",
    [
        ({"type": "PASSWORD", "autocomplete": "email"}, "L1", "password"), ({"autocomplete": "section-a tel"}, "L2", "tel"), ({"autocomplete": "tel cc-number"}, "L2", "cc-number"), ({"autocomplete": "telephone"}, None, None),
        ({"name": "author"}, "L3", "auth"), ({"id": "homepage"}, "L3", "age"), ({"placeholder": "Passport"}, "L3", "pass"), ({"aria_label": "spand"}, None, None), ({"data_test": "x-pan"}, "L3", "pan"), ({"name": "username"}, None, None),
        ({"value": "7412 8536 0906"}, "L4", "aadhaar"), ({"value": "1.1"}, None, None), ({}, None, None), ({"name": "", "autocomplete": ""}, None, None),
    ],
)
def test_cascade(spark, attributes, layer, kind):
    c = digest.classified(table(spark, element(0, **attributes))).first()["class"]
    assert (c and c.layer, c and c.kind) == (layer, kind)


def test_earlier_cascade(spark):
    rows = table(spark, element(0, autocomplete="username"), element(1, type="password"), element(2, name="x", id="dob"), element(3))
    assert [r[0] for r in rows.select(E.classify_v1(digest.attribute)["reason"]).collect()] == ["autocomplete=name", "type=password", 'name/label match: "x dob"', None]


def test_labels(spark):
    e = table(spark, element(0, id="q", aria_labelledby=" b  a zz"), element(1, tag="span", id="a", text="first a"), element(2, tag="span", id="a", text="second a"), element(3, tag="span", id="b", text=None), element(4, tag="span", id="b2"))
    assert [r.labels for r in digest.labelled_by(e).collect()] == [["", "first a"]]
    l = spark.createDataFrame([(1, "q", 2, "Card no"), (1, "q", 1, "Your"), (1, "none", 1, "x")], "page_id BIGINT, for_id STRING, ord INT, text STRING")
    assert digest.with_haystack(e, l).where("ord = 0").first().haystack == "q Your Card no first a"


def test_visibility(spark):
    boxes = [BOX, (0.0, -50.0, 10.0, 20.0), (900.0, 0.0, 10.0, 10.0), (0.0, 0.0, 0.0, 10.0), None, (0.0, 601.0, 5.0, 5.0), (-20.0, 0.0, 10.0, 10.0)]
    e = table(spark, *(element(i, type="password", rect=b) for i, b in enumerate(boxes)), element(9, type="password", hidden=True))
    assert {r.ord: r.visible for r in digest.field_boxes(e, pages(spark)).collect()} == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False, 6: False, 9: False}
    t = table(spark, *(element(i, tag="p", text="mail a@b.com", rect=b) for i, b in enumerate(boxes)), element(10, tag="script", text="mail a@b.com"), element(11, tag="p", text=" a@b "))
    assert sorted(r.ord for r in digest.text_boxes(t, pages(spark)).collect()) == [0, 2, 6]
    assert digest.text_boxes(t, pages(spark), cap=0).count() == 0
    assert digest.full_scan(e.unionByName(t), pages(spark)).count() == 1 + 3


def test_latest_and_empty(spark):
    e = table(spark, element(0, text="old"), element(0, text="new", loaded_at=datetime(2025, 2, 1)), element(0, text="new", loaded_at=datetime(2025, 2, 1)))
    assert [r.text for r in digest.latest(e).collect()] == ["new"]
    assert digest.build_digest(e.limit(0), pages(spark)).count() == 0


def test_digest(spark):
    e = table(
        spark, *(element(i, tag="button", text=f"go {i}") for i in range(160)), element(200, tag="h1", text="  Write to a@b.com \n"), element(201, tag="h2", text=" "), element(202, tag="div", text="no"),
    )
    e = e.unionByName(table(
        spark, element(0, page_id=2, name="email", value="7412 8536 0906"), element(1, page_id=2, tag="a", href="/x", text="y" * 300),
        element(2, page_id=2, tag="a", text="no href"), element(3, page_id=2, tag="div", role="button", value="v"),
    ))
    d = {r.page_id: r for r in digest.build_digest(e, pages(spark, 1, 2, 3)).collect()}
    assert set(d) == {1, 2}
    assert len(d[1].digest.elements) == 150 and [x.i for x in d[1].digest.elements] == list(range(150))
    assert d[1].digest.headings == ["Write to [REDACTED:EMAIL]"] and d[1].digest.url == "https://x.example/1?m=[REDACTED:EMAIL]" and d[1].digest.title is None
    two = d[2].digest.elements
    assert [x.tag for x in two] == ["input", "a", "div"] and two[0].value == "[REDACTED:FIELD]" and two[0].sensitive and two[0].pii_kind == "email" and len(two[1].text) == 120 and two[2].value == "v"
    assert d[2].stats.by_kind == {"field": 1} and d[2].stats.n == 1 and d[2].digest.headings == []


def test_selectors_and_texts(spark):
    df = spark.createDataFrame([("input", "a", "b", "t"), ("input", "", "b", ""), ("input", None, None, None)], "tag STRING, id STRING, name STRING, text STRING")
    assert [tuple(r) for r in df.select(E.selector(df.tag, df.id, df.name), E.selector(df.tag, df.id, df.name, True), E.shown_text(df.text, df.name)).collect()] == [("#a", "#a", "t"), ('[name="b"]', 'input[name="b"]', "b"), ("input", "input", None)]


REQUESTS = "request_id BIGINT, task STRING, dom_elements ARRAY<STRUCT<tag: STRING, id: STRING, name: STRING, type: STRING, text: STRING, selector: STRING, rect: STRUCT<left: DOUBLE, top: DOUBLE, width: DOUBLE, height: DOUBLE>>>, redaction_manifest ARRAY<STRING>, sanitized_image_base64 STRING"
FORM = [("input", "full_name", "full_name", "text", "", "#full_name", (10.0, 20.0, 101.0, 31.0)), ("button", "go", None, "submit", "Confirm order", "#go", (50.0, 60.0, 10.0, 10.0)), ("button", "go2", None, "submit", "Confirm order", "#go2", None), None]


@pytest.mark.parametrize(
    "task, want",
    [
        ("Scroll down", ("scroll", None, 0, 500, None, 0.95)), ("please SCROLL UP", ("scroll", None, 0, -500, None, 0.95)), ("Fill full_name with Alice Johnson", ("type", "#full_name", None, None, "Alice Johnson", 0.92)),
        ("confirm the order", ("click", "#go", 55, 65, None, 0.99)), ("nothing to do", ("click", "#go", 50, 60, None, 0.8)), (None, ("click", "#go", 50, 60, None, 0.8)),
    ],
)
def test_actions(spark, task, want):
    r = actions.act(spark.createDataFrame([(1, task, FORM, ["x"], "i" * 101)], REQUESTS)).first()
    assert (r.type, r.selector, r.x, r.y, r.value, round(r.confidence, 6)) == want and (r.redacted_regions, r.image_chars, r.has_image) == (1, 101, True)


def test_actions_without_elements(spark):
    r = [actions.act(spark.createDataFrame([(1, t, e, None, None)], REQUESTS)).first() for t, e in (("confirm", None), ("click it", []), (None, [None]))]
    assert [(x.type, x.confidence, x.redacted_regions, x.has_image) for x in r] == [("finish", 0.5, 0, False)] * 3


def test_urls(spark):
    df = spark.createDataFrame([("chrome://x",), ("about:blank",), ("https://chrome.example",), (None,)], "url STRING")
    assert [r.url for r in digest.reachable_urls(df).collect()] == ["https://chrome.example"]
    assert df.select(F.count("*")).first()[0] == 4
