import os
import time

import pytest
from pyspark.sql import functions as F

from veilspark import session
from veilspark.operators import actions, digest, fusion, telemetry
from veilspark.streaming import replay

ELEMENTS = "ARRAY<STRUCT<tag: STRING, id: STRING, name: STRING, type: STRING, text: STRING, selector: STRING, rect: STRUCT<left: DOUBLE, top: DOUBLE, width: DOUBLE, height: DOUBLE>>>"


def test_targets(spark):
    els = [("div", None, None, None, None, None, (0.0, 0.0, 100.0, 100.0)), None, ("input", "a", "mail", None, None, None, (10.0, 10.0, 20.0, 20.0)), ("input", "a", "x", None, None, "form > input", None)]
    cases = [("#a", None, None), ('[name="x"]', None, None), ("form > input", 1, 1), ("input", None, None), (None, 15, 15), (":::bad", 99, 99), (None, 100, 50), (None, None, None), ("#b", None, 5)]
    df = spark.createDataFrame([(i, els, *c) for i, c in enumerate(cases)] + [(9, None, "#a", 1, 1), (10, [], "#a", 1, 1)], f"i INT, els {ELEMENTS}, s STRING, x INT, y INT")
    got = [r.t and tuple(r.t) for r in df.orderBy("i").select(actions.target_of(F.col("els"), F.col("s"), F.col("x"), F.col("y")).alias("t")).collect()]
    assert got == [(2, "selector"), (3, "selector"), (3, "selector"), (2, "selector"), (2, "point"), (0, "point"), None, None, None, None, None]


def test_scans_are_joined_by_key(spark, rows):
    f = spark.createDataFrame([(1, "a"), (2, "b")], "frame_id INT, v STRING")
    s = spark.createDataFrame([(2, 7), (3, 8)], "frame_id INT, n INT")
    assert rows(fusion.attach_scans(f, dom=s, timing=s.limit(0))) == [(1, "a", None, None), (2, "b", (7,), None)]


def test_gate_policies(spark):
    frames = spark.createDataFrame([(1, 10.0, 10.0, False), (2, 10.0, 10.0, True)], "frame_id INT, width DOUBLE, height DOUBLE, vision_healthy BOOLEAN")
    masks = spark.createDataFrame([], "frame_id INT, problems ARRAY<STRING>")
    state = lambda **kw: {r.frame_id: (r.state, r.why) for r in fusion.gate_frames(frames, masks, **kw).collect()}
    assert state() == {1: ("quarantine", "vision unhealthy"), 2: ("released", None)}
    assert state(policy="v1") == {1: ("released", "vision unhealthy"), 2: ("released", None)}
    with pytest.raises(ValueError):
        state(policy="open")


def test_exact_percentiles_of_hot_groups(spark, rows):
    """One group holds nearly all rows and most values tie: it is ranked over many partitions."""
    df = spark.range(20_000).select(F.when(F.col("id") < 19_900, "hot").when(F.col("id") < 19_999, "cold").alias("g"), (F.col("id") % 7).cast("double").alias("v"))
    got = {r[0]: r[1:] for r in rows(telemetry.percentiles(df, "g", "v", 0.0, 0.5, 0.95, 1.0))}
    want = {r[0]: (r.n, *r.p) for r in df.groupBy("g").agg(F.count("*").alias("n"), F.percentile("v", F.array(*map(F.lit, (0.0, 0.5, 0.95, 1.0)))).alias("p")).collect()}
    assert got == want and len(got) == 3
    assert telemetry.percentiles(df.limit(0), "g", "v", 0.5).count() == 0


def test_latest_page_and_preview(spark, rows):
    p = spark.createDataFrame([(1, "a", "https://x.test", 5), (2, "a", "chrome://flags", 9), (3, "a", "https://y.test", 5), (4, "b", None, 1), (5, None, "https://z.test", None)], "page_id INT, site STRING, url STRING, first_seen INT")
    assert rows(digest.latest_page(p)) == [("a", 3, "https://y.test"), (None, 5, "https://z.test")]
    t = spark.createDataFrame([("é" * 5,), ("",), (None,)], "t STRING")
    assert [tuple(r[0]) if r[0][0] is not None else None for r in t.select(digest.preview(F.col("t"), 3)).collect()] == [("ééé", 2), ("", 0), None]


def test_latest_keeps_and_reads_the_named_columns(spark, rows):
    e = spark.createDataFrame([(1, 0, 1, "old", "x", "y"), (1, 0, 2, "new", None, "z"), (1, 1, 1, None, None, None)], "page_id INT, ord INT, loaded_at INT, text STRING, href STRING, tag STRING")
    assert rows(digest.latest(e, ("href", "text"))) == [(1, 0, None, "new"), (1, 1, None, None)]
    assert digest.latest(e, ("href",)).columns == ["page_id", "ord", "href"]


def test_spread_goes_by_bytes_and_files(spark, tmp_path):
    spark.range(1000).repartition(2).write.parquet(str(tmp_path / "few"))
    spark.range(1000).repartition(40).write.parquet(str(tmp_path / "many"))
    few, many = spark.read.parquet(str(tmp_path / "few")), spark.read.parquet(str(tmp_path / "many"))
    assert 0 < session.input_bytes(few) < 1_000_000
    assert "Repartition" in session.spread(few)._jdf.queryExecution().optimizedPlan().toString()
    assert session.spread(many) is many  # enough files: no shuffle
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        assert session.spread(few) is few  # large for its few files: no shuffle either
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_shared_folder(spark):
    class Cluster:
        master = "spark://host:7077"

    class Session:
        sparkContext, conf = Cluster, type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session, "x")
    session._WRITTEN.clear()
    df = session.materialise(spark.range(3).toDF("n"), "kept")
    path = session._WRITTEN[0]
    assert df.count() == 3 and os.path.isdir(path.removeprefix("file://"))
    assert session.clear_shared(spark) == 1 and not os.path.isdir(path.removeprefix("file://")) and session.clear_shared(spark) == 0


def test_interval_trigger_keeps_running(spark, tmp_path):
    """A query with ``every`` takes up what arrives later, too."""
    spark.createDataFrame([(1, "mail a@b.com")], "i INT, text STRING").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i INT, text STRING").parquet(str(tmp_path / "in"))
    query, out = replay.start(replay.scrubbed(stream), "interval", every="1 second")
    try:
        for n in (1, 2):
            until = time.time() + 60
            while time.time() < until and (not os.path.isdir(out.removeprefix("file://")) or spark.read.schema("i INT, text STRING").parquet(out).count() < n):
                time.sleep(0.5)
            if n == 1:
                spark.createDataFrame([(2, "plain")], "i INT, text STRING").write.mode("append").parquet(str(tmp_path / "in"))
    finally:
        query.stop()
    assert sorted(tuple(r) for r in spark.read.schema("i INT, text STRING").parquet(out).collect()) == [(1, "mail [REDACTED:EMAIL]"), (2, "plain")]


def test_resource_summary_of_a_table(spark, rows):
    s = spark.createDataFrame([(1, 3, 5.0), (1, 1, 0.0), (1, 2, 4.0), (2, 1, None), (1, 4, 4.5)], "session INT, at INT, used DOUBLE")
    assert rows(replay.resource_summary(s)) == [(1, 3, 4.0, 5.0, 4.5, 0.5)]
