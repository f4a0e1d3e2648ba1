import json
from datetime import datetime

from veilspark.operators import nested

BODY = {"meta": {"v": 1}, "payload": {"task": "t", "dom_elements": [{"tag": "a", "rect": [1, 2, 3, 4], "children": [None, {"tag": "b", "rect": None, "children": {"tag": "c", "redaction_manifest": {"label": "x"}}}]}, None], "redaction_manifest": [None, {"label": "y", "box": [1, 2, 3, 4]}]}}
LINKS = {("element", "0", ""), ("rect", "0/rect", "0"), ("element", "0.1", "0"), ("element", "0.1.0", "0.1"), ("redaction", "0.1.0/0", "0.1.0"), ("redaction", "1", "")}


def _links(rows):
    return {(k, p, q) for _, k, p, q, *_ in rows if k not in ("request", "unreadable")}


def test_links_and_positions(spark, rows):
    df = spark.createDataFrame([(1, json.dumps(BODY)), (1, json.dumps(BODY))], "request_id BIGINT, body STRING")
    assert _links(rows(nested.distinct_nodes(nested.emit_tagged(df)))) == LINKS


def test_json_in_strings_and_lone_objects():
    texted = dict(BODY["payload"], dom_elements=json.dumps(BODY["payload"]["dom_elements"]))
    assert {(k, p, q) for k, p, q, _ in nested.visit(nested.parse_body(json.dumps(json.dumps(texted))))} - {("request", "", "")} == LINKS
    lone = {"dom_elements": {"tag": "a", "rect": '{"x": 1}'}}
    assert [x[:3] for x in nested.visit(nested.parse_body(json.dumps(lone)))] == [("request", "", ""), ("element", "0", ""), ("rect", "0/rect", "0")]


def test_unreadable_bodies(spark, rows):
    bad = [None, "", "   ", "nope", '{"dom_elements": [', "NaN", '{"task": NaN}', "[1, 2]", '"x"', "{}", "[" * 100_000]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "request_id BIGINT, body STRING")
    assert [(r[1], r[2]) for r in rows(nested.emit_tagged(df))] == [("unreadable", "")] * len(bad)


def test_long_wide_and_null_key(spark, rows):
    body = json.dumps({"task": "x" * 300_000, "dom_elements": [{"tag": "p", "text": "y" * 1000}] * 30_000})
    df = spark.createDataFrame([(None, body)], "request_id BIGINT, body STRING")
    assert nested.emit_tagged(df, with_fields=False).where("node_kind = 'element' AND request_id IS NULL").count() == 30_000


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "request_id BIGINT, body STRING, node_kind STRING, fields STRING")
    assert nested.emit_tagged(df).count() == 0
    df = spark.createDataFrame([(1, '{"task": "a"}', "z", "z")], df.schema)
    assert nested.emit_tagged(df).columns == ["request_id", "node_kind", "node_path", "parent_path", "fields"]


def test_tables_by_tag(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, json.dumps(BODY))], "request_id BIGINT, body STRING")
    nested.write_tables(nested.emit_tagged(df), str(tmp_path / "t"))
    assert rows(nested.read_table(spark, str(tmp_path / "t"), "redaction").select("node_path", "label", "box")) == [("0.1.0/0", "x", None), ("1", "y", "[1, 2, 3, 4]")]
    assert nested.read_table(spark, str(tmp_path / "t"), "unreadable").count() == 0


def test_parsed_arrays(spark, rows):
    s = "request_id BIGINT, dom_elements ARRAY<STRUCT<tag: STRING, rect: STRUCT<left: DOUBLE>>>, redaction_manifest ARRAY<STRUCT<label: STRING>>"
    df = spark.createDataFrame([(1, [None, ("a", None), ("b", (1.0,))], None), (2, None, []), (3, [], [("x",), None])], s)
    assert rows(nested.flatten_arrays(df)) == [(1, "element", "1", ""), (1, "element", "2", ""), (1, "rect", "2/rect", "2"), (3, "redaction", "0", "")]


def test_parsed_requests_keep_their_fields(spark, rows, tmp_path):
    s = "request_id BIGINT, task STRING, viewport MAP<STRING, DOUBLE>, capture_note STRING, received_at TIMESTAMP, dom_elements ARRAY<STRUCT<tag: STRING, text: STRING, is_interactive: BOOLEAN, rect: STRUCT<left: DOUBLE, top: DOUBLE>>>, redaction_manifest ARRAY<STRUCT<label: STRING, box: ARRAY<INT>>>"
    at = [datetime(2025, 1, 1), datetime(2025, 1, 2)]
    data = [(1, "t", {"w": 8.0}, "in mm", t, [None, ("a", 'x "1"', True, None), ("b", None, None, (1.5, None))], [None, ("y", [1, 2, 3, 4])]) for t in at]
    tagged = nested.emit_arrays(spark.createDataFrame([*data, (2, None, None, None, None, None, [])], s))
    assert [(f.name, f.dataType) for f in tagged.schema] == [(f.name, f.dataType) for f in spark.createDataFrame([], nested.TAGGED).schema]
    body = spark.createDataFrame([(3, json.dumps({"task": "u", "dom_elements": [{"tag": "c", "rect": [1, 2, 3, 4]}]}))], "request_id BIGINT, body STRING")
    nested.write_tables(tagged.unionByName(nested.emit_tagged(body)), str(tmp_path / "t"))
    read = lambda kind, *names: rows(nested.read_table(spark, str(tmp_path / "t"), kind).distinct().select("request_id", "node_path", "parent_path", *names))
    assert read("request", "task", "viewport", "capture_note") == [(1, "", "", "t", '{"w":8.0}', "in mm"), (2, "", "", None, None, None), (3, "", "", "u", None, None)]
    assert read("element", "tag", "text", "is_interactive") == [(1, "1", "", "a", 'x "1"', True), (1, "2", "", "b", None, None), (3, "0", "", "c", None, None)]
    assert read("rect", "value") == [(1, "2/rect", "2", '{"left":1.5}'), (3, "0/rect", "0", "[1, 2, 3, 4]")]
    assert read("redaction", "label", "box") == [(1, "1", "", "y", "[1,2,3,4]")]


def test_links_come_from_the_tagged_tables(spark, rows, tmp_path):
    body = '{"task": "t", "dom_elements": [{"tag": "a", "rect": {"x": 1}, "children": {"tag": "b", "redaction_manifest": [null, {"label": "l"}]}}]}'
    df = spark.createDataFrame([(1, body), (1, body), (2, None)], "request_id BIGINT, body STRING")
    nested.write_tables(nested.emit_tagged(df), str(tmp_path / "t"))
    assert rows(nested.links_of(spark, str(tmp_path / "t"), "element", "rect", "redaction")) == [(1, "element", "0", ""), (1, "element", "0.0", "0"), (1, "rect", "0/rect", "0"), (1, "redaction", "0.0/1", "0.0")]
    assert nested.read_table(spark, str(tmp_path / "t"), "element").where("tag = 'b'").count() == 2
