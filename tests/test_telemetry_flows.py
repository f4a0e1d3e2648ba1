import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilspark.functions.text import scan_text
from veilspark.operators import telemetry
from veilspark.plans import flows, measure
from veilspark.sources import html
from veilspark.sources import json as vjson
from veilspark.streaming import replay

T0 = datetime(2025, 1, 1)


def _frames(spark, rows):
    return spark.createDataFrame([(s, T0 + timedelta(seconds=i), float(v)) for s, i, v in rows], "session BIGINT, ts TIMESTAMP, total DOUBLE")


def test_percentiles(spark):
    t = spark.createDataFrame([("a", float(v)) for v in (10, 20, 30, 40, 100)] + [("b", 0.0), ("b", 10.0), ("c", None)], "stage STRING, ms DOUBLE")
    assert {r.stage: (r.n, r.p50, r.p95) for r in telemetry.stage_percentiles(t).collect()} == {"a": (5, 30, 88), "b": (2, 5, 9.5)}
    assert telemetry.stage_percentiles(t.limit(0)).count() == 0


def test_cold_and_steady(spark):
    f = _frames(spark, [(1, 0, 1000), *((1, i, 50) for i in range(1, 5)), (2, 0, 7)])
    s = {r.session: r for r in telemetry.steady_state(f).collect()}
    assert (s[1].cold, s[1].n, s[1].p50, s[1].fps) == (1000, 4, 50, 20) and (s[2].cold, s[2].n, s[2].p50, s[2].fps) == (7, 0, None, None)


def test_ring_buffer_and_ordinals(spark):
    f = _frames(spark, [(s, i, i) for s in (1, 2) for i in range(700 if s == 1 else 3)])
    assert {r.session: r["count"] for r in telemetry.ring_buffer(f).groupBy("session").count().collect()} == {1: 500, 2: 3}
    assert sorted(r.ordinal for r in telemetry.numbered(f.where("session = 2")).collect()) == [0, 1, 2]


def test_frames_shares_and_heap(spark):
    t = spark.createDataFrame([(1, 1, T0, "a", 30.0), (1, 1, T0, "b", 10.0), (1, 1, T0, "a", 20.0), (1, 2, T0, "a", 0.0), (1, 3, T0, "a", None)], "session BIGINT, frame INT, ts TIMESTAMP, stage STRING, ms DOUBLE")
    f = telemetry.frames_of(t)
    assert {(r.frame, r.total): r.stages for r in f.collect()} == {(1, 60.0): {"a": 50.0, "b": 10.0}, (2, 0.0): {"a": 0.0}}
    shares = {(r.frame, r.stage): (round(r.share, 3), r.place) for r in telemetry.stage_share(f).collect()}
    assert shares == {(1, "a"): (0.833, 1), (1, "b"): (0.167, 2), (2, "a"): (0.0, 1)}
    assert telemetry.with_unaccounted(f.selectExpr("*").withColumn("total", f.total - 5)).where("frame = 1").first().unaccounted == 0
    assert telemetry.console_lines(f).where("frame = 1").first().line == "frame 1: 60.0 ms (a 50.0, b 10.0)" and json.loads(telemetry.export(f).where("frame = 2").first().json)["total"] == 0
    h = spark.createDataFrame([(1, 3, 9.0), (1, 1, 4.0), (1, 0, 0.0), (1, 2, 12.0), (1, 4, None)], "session BIGINT, at INT, used DOUBLE")
    assert tuple(telemetry.heap_summary(h).first()) == (1, 4.0, 12.0, 9.0, 5.0)
    o = spark.createDataFrame([({"network": 1.0, "capture": 2.0, "other": 3.0},)], "stages MAP<STRING, DOUBLE>")
    assert list(telemetry.ordered_stages(o).first().stages) == ["capture", "network"]


def _stream(spark, folder, rows, schema, files):
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(f"{folder}/events.parquet")
    return replay.stream_table(spark, str(folder), "events", files_per_trigger=1)


def test_streams_equal_batch(spark, tmp_path):
    rows = [(T0 + timedelta(minutes=i), i % 3, "ab"[i % 2], float(i)) for i in range(240)]
    events = _stream(spark, tmp_path, rows, "ts TIMESTAMP, session BIGINT, event_type STRING, value DOUBLE", 1)
    out = replay.last_of(replay.run_available(replay.windowed_counts(events), "w", "update"), "start", "event_type")
    assert {(r.start.hour, r.event_type): r.n for r in out.collect()} == {(h, k): 30 for h in range(4) for k in "ab"}
    history = replay.bounded_history(events.withColumnRenamed("value", "ms"), size=50)
    last = {r.session: (r.n, r.p50) for r in replay.last_of(replay.run_available(history, "h", "update"), "session").collect()}
    want = {s: sorted(float(i) for i in range(240) if i % 3 == s)[-50:] for s in range(3)}
    assert last == {s: (50, (v[24] + v[25]) / 2) for s, v in want.items()}


def _counts(out):
    return {(r.start.hour, r.event_type): r.n for r in out.collect()}


def test_windows_of_unordered_files(spark, tmp_path):
    """Every file spans the whole period, so the first batch puts the rows of the third and later ones late; the query reads 8 a batch."""
    rows = [(T0 + timedelta(minutes=i), i % 3, "ab"[i % 2], float(i)) for i in range(240)]
    events = _stream(spark, tmp_path, rows, "ts TIMESTAMP, session BIGINT, event_type STRING, value DOUBLE", 30)
    want = {(h, k): 30 for h in range(4) for k in "ab"}
    out = replay.run_available(replay.windowed_counts(events, late=None), "w30", "update")
    assert out.select("batch").distinct().count() == 30 and _counts(replay.last_of(out, "start", "event_type")) == want
    assert _counts(flows.stream_windows(spark, str(tmp_path))) == want


def test_history_over_several_batches(spark, tmp_path):
    rows = [(T0 + timedelta(seconds=i), 1, float(i)) for i in range(100)]
    history = replay.bounded_history(_stream(spark, tmp_path, rows, "ts TIMESTAMP, session BIGINT, ms DOUBLE", 4), size=10)
    out = replay.run_available(history, "h4", "update")
    assert out.select("batch").distinct().count() == 4
    assert replay.last_of(out, "session").first().p50 == 94.5


def test_stream_scrub(spark, tmp_path):
    t = _stream(spark, tmp_path, [(1, "a@b.com"), (2, None), (3, "x")], "i INT, text STRING", 2)
    assert sorted((r.i, r.text, r.redactions) for r in replay.run_available(replay.scrubbed(t), "s").collect()) == [(1, "[REDACTED:EMAIL]", 1), (2, None, 0), (3, "x", 0)]


def test_html(spark, rows):
    page = '<html><h1>Hi &amp; bye you</h1><script>var x = 1234567;</script><p>caf&eacute; time<br>again, please<INPUT type=text NAME="q" aria-label="Find"/><img src=x></p>tail text</div>'
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>open")], "page_id BIGINT, html STRING")
    assert [(r[2], r[3]) for r in rows(html.acceptable(html.text_nodes(df)))] == [("h1", "Hi & bye you"), ("p", "café time"), ("p", "again, please"), ("html", "tail text")]
    e = html.html_elements(df).where("tag = 'input'").first()
    assert (e.type, e.name, e.aria_label, e.value) == ("text", "q", "Find", None)
    assert html.text_nodes(df.limit(0)).count() == 0


def test_json_sources(spark, tmp_path, rows):
    cases = [{"id": "c1", "category": "x", "name": "n", "description": "d", "ground_truth_pii": [{"type": "email", "label": "e", "box": [1, 2, 3, 4]}]}, {"id": "c2", "category": "y"}]
    (tmp_path / "a.json").write_text(json.dumps(cases))
    a = vjson.read_annotations(spark, str(tmp_path / "a.json"))
    assert rows(a.select("id", "category")) == [("c1", "x"), ("c2", "y")] and rows(vjson.annotation_boxes(a)) == [("c1", "x", 0, "email", "e", [1, 2, 3, 4])]
    (tmp_path / "r.json").write_text(json.dumps({"total": 1, "case_by_case": [{"id": "c1", "tp": 2, "precision": 0.5}]}))
    assert rows(vjson.read_results(spark, str(tmp_path / "r.json")).select("id", "tp", "fp", "precision")) == [("c1", 2, None, 0.5)]
    b = spark.createDataFrame([(1, '{"task": "t", "url": "u"}'), (2, "{"), (3, None), (4, '{"dom_elements": [{"rect": "text"}]}')], "i INT, body STRING")
    assert rows(vjson.parse_requests(b).select("i", "malformed", "plain", "parsed_task")) == [(1, False, True, "t"), (2, True, False, None), (3, True, False, None), (4, False, False, None)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data here")
def test_parity_covers_all_texts(spark, monkeypatch):
    """A native scanner that misses everything differs on texts of each table."""
    texts = measure._scanned(spark, "/root/testdata/sf0.001")
    kinds = texts.where("text IS NOT NULL").select(F.regexp_replace("key", r"\d+", "0").alias("k")).distinct()
    assert {r.k for r in kinds.collect()} == {"0-0", "r0", "r0-0", "d0"}
    own = spark.createDataFrame([("d1", "mail a@b.com"), ("d2", "mail a@b.com"), ("0-1", None)], "key STRING, text STRING")
    assert measure._scanner_differences(own).count() == 0
    monkeypatch.setattr(measure, "scan_text", lambda c: scan_text(F.substring(c, 1, 0)))
    assert [(r.key, r.kind) for r in measure._scanner_differences(own).collect()] == [("d1", "email")]
