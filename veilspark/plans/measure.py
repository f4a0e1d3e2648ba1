"""Queries of evaluation and telemetry. Events stand for timings: stage, milliseconds and session of an event."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udf
from ..functions.text import scan_text
from ..operators import evaluate, telemetry
from . import vision
from .sqlgen import hits_sql
from .tables import table
from .text import SAMPLES, _texts, samples

_POSITIVE = 13  # the first samples are identifiers, those up to 21 are not


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Requests as cases: their redaction items, those from the page's elements (found) and those without a label (wrong)."""
    r = table(spark, d, "requests").select("request_id", F.coalesce("client", F.lit("")).alias("category"), F.coalesce("redaction_manifest", F.array()).alias("m")).dropDuplicates(["request_id"])
    count = lambda test: F.size(F.filter("m", test)).cast("bigint")
    tp = count(lambda x: F.lower(F.trim(x["source"])) == "dom")
    return r.select("request_id", "category", tp.alias("tp"), count(lambda x: x["label"].isNull()).alias("fp"), (F.size("m") - tp).alias("fn"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def prf_per_case(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluate.per_case(_cases(spark, d)), "precision", "recall", "f1")


def prf_micro(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluate.by(_cases(spark, d)), "precision", "recall", "f1")


def prf_by_category(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluate.by(_cases(spark, d), "category"), "precision", "recall", "f1")


def seed_confusion(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark).where("doc_id < 21").select((F.col("doc_id") < _POSITIVE).alias("expected"), (F.size(scan_text(F.col("text"))) > 0).alias("found"))
    return evaluate.confusion(s, "expected", "found")


def box_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many DOM boxes the vision boxes find by overlap, and how many of those are right, by frame."""
    return evaluate.box_cases(vision.dom_boxes(spark, d), vision._model(spark, d)).select("frame_id", "tp", "fp", "fn")


def _scanner_differences(texts: DataFrame) -> DataFrame:
    """Hits of (key, text) on which the native scanner and the Python one disagree; equal texts are scanned once, under one of their keys."""
    spark = texts.sparkSession
    udf.register_sql(spark)
    t = texts.where("text IS NOT NULL").groupBy("text").agg(F.min("key").alias("key"))
    native = t.select("key", F.inline(scan_text(F.col("text")))).select("key", F.col("id").alias("kind"), "match", "idx")
    t.createOrReplaceTempView("veil_texts")
    python = spark.sql("SELECT t.key, r.kind, r.match, r.idx FROM veil_texts t, LATERAL scan_text_rows(t.text) r")
    return evaluate.differences(native, python)


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    """(key, text) of all texts that the native scanner is used on: of elements, tasks, ``dom_elements`` (``r1-0``) and documents (``d1``)."""
    dom = table(spark, d, "requests").select("request_id", F.posexplode("dom_elements.text").alias("at", "text")).select(F.concat(F.lit("r"), "request_id", F.lit("-"), "at").alias("key"), "text")
    documents = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), "text")
    return _texts(spark, d).select("key", "text").unionByName(dom).unionByName(documents)


def detector_parity(spark: SparkSession, d: str) -> DataFrame:
    """Hits on which the native scanner and the Python one disagree: none. ``request_id`` is the text's key, a request's or not."""
    return _scanner_differences(_scanned(spark, d)).withColumnRenamed("key", "request_id")


def _timings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("session"), F.date_trunc("hour", "ts").alias("frame"), "ts", F.col("event_type").alias("stage"), F.col("value").alias("ms"), "event_id")


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """An hour of a session is a frame whose total is a quarter more than its stages."""
    return telemetry.frames_of(_timings(spark, d)).withColumn("total", F.col("total") * 1.25)


def _events_as_frames(spark: SparkSession, d: str) -> DataFrame:
    return _timings(spark, d).select("session", "ts", F.col("ms").alias("total"))


def _r(*columns: str) -> list[Column]:
    return [F.round(c, 6).alias(c) for c in columns]


def stage_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.stage_percentiles(_timings(spark, d)).select("stage", "n", *_r("mean", "p50", "p95"))


def unaccounted(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.with_unaccounted(_frames(spark, d)).groupBy("session").agg(F.count("*").alias("frames"), F.round(F.sum("unaccounted"), 6).alias("unaccounted"))


def frame_ordinals(spark: SparkSession, d: str) -> DataFrame:
    n = telemetry.numbered(_events_as_frames(spark, d))
    return n.groupBy("session").agg(F.max("ordinal").cast("bigint").alias("last"), F.sum(F.col("ordinal") * F.col("total")).alias("w")).select("session", "last", F.round("w", 3).alias("weighted"))


def ring_buffer_500(spark: SparkSession, d: str) -> DataFrame:
    b = telemetry.ring_buffer(_events_as_frames(spark, d))
    return b.groupBy("session").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"), F.round(F.sum("total"), 3).alias("total"))


def steady_vs_cold(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.steady_state(_events_as_frames(spark, d)).select("session", "n", *_r("cold", "p50", "p95", "fastest", "slowest", "fps"))


def stage_shares(spark: SparkSession, d: str) -> DataFrame:
    s = telemetry.stage_share(_frames(spark, d)).where("place = 1")
    return s.groupBy("stage").agg(F.count("*").alias("longest_in"), F.round(F.sum("share"), 6).alias("share_sum"))


def heap_summary(spark: SparkSession, d: str) -> DataFrame:
    s = _timings(spark, d).select("session", F.struct("ts", "event_id").alias("at"), F.col("ms").alias("used"))
    return telemetry.heap_summary(s).select("session", *_r("first", "peak", "last", "delta"))


def metrics_export(spark: SparkSession, d: str) -> DataFrame:
    """Every frame as JSON and as a line of text."""
    f = _frames(spark, d)
    return telemetry.export(f).join(telemetry.console_lines(f), ["session", "frame"])


def ordered_stage_maps(spark: SparkSession, d: str) -> DataFrame:
    """Stages in reporting order; event types stand for stages by their rank."""
    stage = F.element_at(F.array(*map(F.lit, ("merge", "capture", "encode", "decode", "network"))), F.pmod(F.length("stage"), F.lit(5)) + 1)
    f = telemetry.frames_of(_timings(spark, d).withColumn("stage", stage))
    return telemetry.ordered_stages(f).groupBy(F.array_join(F.map_keys("stages"), ">").alias("stages")).agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        prf_per_case, prf_micro, prf_by_category, seed_confusion, box_recall, detector_parity, stage_percentiles, unaccounted, frame_ordinals, ring_buffer_500, steady_vs_cold, stage_shares, heap_summary,
        metrics_export, ordered_stage_maps,
    )
}
_CASES = """WITH r AS (SELECT DISTINCT request_id, coalesce(client, '') AS category, coalesce(redaction_manifest, []) AS m FROM requests),
c AS (SELECT request_id, category, CAST(len(list_filter(m, lambda x: lower(trim(x.source)) = 'dom')) AS BIGINT) AS tp, CAST(len(list_filter(m, lambda x: x.label IS NULL)) AS BIGINT) AS fp, CAST(len(m) - len(list_filter(m, lambda x: lower(trim(x.source)) = 'dom')) AS BIGINT) AS fn FROM r)"""
_SCORES = "round(p, 9) AS precision, round(q, 9) AS recall, round(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END, 9) AS f1"
_PQ = "CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fn) END AS q"
_EV = "WITH t AS (SELECT user_id AS session, date_trunc('hour', ts) AS frame, ts, event_type AS stage, value AS ms, event_id FROM events)"
_FR = _EV + ", s AS (SELECT session, frame, stage, sum(ms) AS ms FROM t GROUP BY ALL), f AS (SELECT session, frame, sum(ms) AS spent, sum(ms) * 1.25 AS total FROM s GROUP BY ALL)"
_EXP = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(SAMPLES[:21])) + ") v(doc_id, text))"
_ST = "CASE length(stage) % 5 WHEN 0 THEN 'merge' WHEN 1 THEN 'capture' WHEN 2 THEN 'encode' WHEN 3 THEN 'decode' ELSE 'network' END"
SQL: dict[str, str] = {
    "prf_per_case": f"{_CASES} SELECT request_id, category, tp, fp, fn, {_SCORES} FROM (SELECT *, {_PQ} FROM c)",
    "prf_micro": f"{_CASES} SELECT cases, tp, fp, fn, {_SCORES} FROM (SELECT *, {_PQ} FROM (SELECT count(*) AS cases, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c))",
    "prf_by_category": f"{_CASES} SELECT category, cases, tp, fp, fn, {_SCORES} FROM (SELECT *, {_PQ} FROM (SELECT category, count(*) AS cases, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c GROUP BY category))",
    "seed_confusion": f"SELECT tp, fn, tn, fp, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM (SELECT CAST(count_if(e AND f) AS BIGINT) AS tp, CAST(count_if(e AND NOT f) AS BIGINT) AS fn, CAST(count_if(NOT e AND NOT f) AS BIGINT) AS tn, CAST(count_if(NOT e AND f) AS BIGINT) AS fp FROM (SELECT doc_id < 13 AS e, doc_id IN (SELECT doc_id FROM ({hits_sql('doc_id', _EXP)})) AS f FROM {_EXP}))",
    "box_recall": vision._INPUTS
    + f"""SELECT frame_id, coalesce(tp, 0) AS tp, coalesce(nm, 0) - coalesce(rt, 0) AS fp, coalesce(nd, 0) - coalesce(tp, 0) AS fn FROM (SELECT frame_id, count(*) AS nd, CAST(count_if(EXISTS (SELECT 1 FROM model m WHERE m.frame_id = d.frame_id AND {vision._iou_sql("m", "d")} > 0.5)) AS BIGINT) AS tp FROM dom d GROUP BY frame_id) a FULL JOIN (SELECT frame_id, count(*) AS nm, CAST(count_if(EXISTS (SELECT 1 FROM dom d WHERE d.frame_id = m.frame_id AND {vision._iou_sql("m", "d")} > 0.5)) AS BIGINT) AS rt FROM model m GROUP BY frame_id) b USING (frame_id)""",
    "detector_parity": "SELECT request_id, '' AS kind, '' AS match, 0 AS idx, '' AS only_in FROM requests WHERE false",
    "stage_percentiles": _EV + " SELECT stage, count(*) AS n, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95 FROM t WHERE ms IS NOT NULL GROUP BY stage",
    "unaccounted": _FR + " SELECT session, count(*) AS frames, round(sum(greatest(0, total - spent)), 6) AS unaccounted FROM f GROUP BY session",
    "frame_ordinals": _EV + " SELECT session, max(o) AS last, round(sum(o * ms), 3) AS weighted FROM (SELECT session, ms, row_number() OVER (PARTITION BY session ORDER BY ts, ms) - 1 AS o FROM t) GROUP BY session",
    "ring_buffer_500": _EV + " SELECT session, count(*) AS n, min(ts) AS oldest, round(sum(ms), 3) AS total FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, ms DESC) AS k FROM t) WHERE k <= 500 GROUP BY session",
    "steady_vs_cold": _EV
    + " SELECT session, count(*) FILTER (o >= 1) AS n, round(arg_min(ms, o), 6) AS cold, round(quantile_cont(ms, 0.5) FILTER (o >= 1), 6) AS p50, round(quantile_cont(ms, 0.95) FILTER (o >= 1), 6) AS p95, round(min(ms) FILTER (o >= 1), 6) AS fastest, round(max(ms) FILTER (o >= 1), 6) AS slowest, round(1000.0 / nullif(quantile_cont(ms, 0.5) FILTER (o >= 1), 0), 6) AS fps FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, ms) - 1 AS o FROM t) GROUP BY session",
    "stage_shares": _FR + " SELECT stage, count(*) AS longest_in, round(sum(share), 6) AS share_sum FROM (SELECT s.stage, s.ms / f.spent AS share, row_number() OVER (PARTITION BY s.session, s.frame ORDER BY s.ms DESC, s.stage) AS k FROM s JOIN f USING (session, frame)) WHERE k = 1 GROUP BY stage",
    "heap_summary": _EV + " SELECT session, round(a, 6) AS first, round(b, 6) AS peak, round(c, 6) AS last, round(c - a, 6) AS delta FROM (SELECT session, arg_min(ms, (ts, event_id)) AS a, max(ms) AS b, arg_max(ms, (ts, event_id)) AS c FROM t WHERE ms > 0 GROUP BY session)",
    "ordered_stage_maps": _EV
    + f", s AS (SELECT DISTINCT session, frame, {_ST} AS st FROM t WHERE ms IS NOT NULL) SELECT stages, count(*) AS n FROM (SELECT session, frame, string_agg(st, '>' ORDER BY list_position(['capture', 'decode', 'merge', 'encode', 'network'], st)) AS stages FROM s GROUP BY session, frame) GROUP BY stages",
}
