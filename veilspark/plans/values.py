"""Queries of converted values, targets of actions, attached scans and reports that are compared value by value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import udf
from ..functions.text import redact_fields, scan_text, scrub_text
from ..operators import actions, digest, fusion
from ..session import materialise
from ..streaming import replay
from . import vision
from .pages import _ACT, _BASE, _EVIDENCE, _elements, _pages, _written_elements
from .sqlgen import hits_sql, scrubbed_sql
from .tables import table
from .text import _T, _texts


def coord_values(spark: SparkSession, d: str) -> DataFrame:
    """Every element's rect in the document's space and in the model's, value by value."""
    e = vision._elements(spark, d).join(vision.frames(spark, d), "frame_id")
    capture = G.css_to_capture(F.col("rect"), F.col("dpr"))
    spaces = {"document": G.viewport_to_document(F.col("rect"), F.col("scroll_x"), F.col("scroll_y")), "model": G.capture_to_model(capture, G.letterbox(F.col("width"), F.col("height"), 640.0))}
    return e.select("frame_id", "ord", *(F.round(r[n], 6).alias(f"{space}_{n}") for space, r in spaces.items() for n in "xywh"))


def viewport_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of frames of which some have no usable pixel ratio: those have none."""
    p = table(spark, d, "page_index").select("page_id", (F.col("page_id") % 4 - 1).cast("double").alias("dpr"), F.when(F.col("page_id") % 3 > 0, (F.col("page_id") % 50).cast("double")).alias("sx"), "viewport_w", "viewport_h")
    c = p.select("page_id", G.viewport_context(F.col("dpr"), F.col("sx"), F.lit(None).cast("double"), F.col("viewport_w"), F.col("viewport_h")).alias("c"))
    return c.select("page_id", F.col("c").isNotNull().alias("usable"), F.col("c.dpr").alias("dpr"), F.col("c.scroll_x").alias("scroll_x"), F.col("c.scroll_y").alias("scroll_y"), F.col("c.width").cast("bigint").alias("width"), F.col("c.height").cast("bigint").alias("height"))


def iou_unclamped(spark: SparkSession, d: str) -> DataFrame:
    """IoU of rects with sizes taken as they are, negative ones too."""
    e = vision._elements(spark, d)
    a, b = G.rect(F.col("rect.x"), F.col("rect.y"), F.col("rect.w") - 60, F.col("rect.h")), G.rect(F.col("rect.x") + 5, F.col("rect.y"), F.col("rect.w"), F.col("rect.h"))
    return e.select("frame_id", "ord", F.round(G.iou(a, b, clamp=False), 9).alias("iou"))


def release_v1(spark: SparkSession, d: str) -> DataFrame:
    """The earlier gate, for comparison: what would have gone out although something failed."""
    prepared = fusion.prepared_masks(vision._masks(spark, d), vision.frames(spark, d))
    return fusion.gate_frames(vision.frames(spark, d), prepared, policy="v1").select("frame_id", "state", "why")


def resolved_targets(spark: SparkSession, d: str) -> DataFrame:
    """The element each request's action is dispatched to, by selector or by point."""
    return actions.resolve_targets(table(spark, d, "requests")).distinct()


def frames_with_scans(spark: SparkSession, d: str) -> DataFrame:
    """Frames with what the page scan and the model found, by key."""
    dom = vision.dom_boxes(spark, d).groupBy("frame_id").agg(F.count("*").alias("boxes"), F.count_distinct("kind").alias("kinds"))
    model = vision._model(spark, d).groupBy("frame_id").agg(F.count("*").alias("boxes"), F.round(F.max("score"), 6).alias("top"))
    j = fusion.attach_scans(vision.frames(spark, d).select("frame_id", "dpr"), dom=dom, model=model)
    return j.select("frame_id", "dpr", F.col("dom.boxes").alias("dom_boxes"), F.col("dom.kinds").alias("dom_kinds"), F.col("model.boxes").alias("model_boxes"), F.col("model.top").alias("model_top"))


def latest_pages(spark: SparkSession, d: str) -> DataFrame:
    """The page seen last of every site."""
    return digest.latest_page(_pages(spark, d))


def body_previews(spark: SparkSession, d: str) -> DataFrame:
    """Payloads as people see them: the first 4,000 characters and how many more there are."""
    return table(spark, d, "act_payloads").select("request_id", digest.preview(F.col("body")).alias("p")).select("request_id", "p.shown", F.col("p.more").cast("bigint").alias("more")).distinct()


def redacted_elements(spark: SparkSession, d: str) -> DataFrame:
    """Text fields of elements after redaction; the value of a password field is blanked whatever it holds."""
    e = _elements(spark, d, "type", "placeholder", "text", "value").withColumn("e", F.struct("placeholder", "text", "value"))
    r = e.withColumn("r", redact_fields(F.col("e"), ("placeholder", "text", "value"), F.coalesce(F.col("type") == "password", F.lit(False))))
    return r.where("NOT r <=> e").select("page_id", "ord", "r.placeholder", "r.text", "r.value")


def rescan_after_scrub(spark: SparkSession, d: str) -> DataFrame:
    """Texts that were scrubbed once, what was replaced in them, and what a second scan finds: what the first redaction uncovered."""
    s = _texts(spark, d).select("key", scrub_text(F.col("text")).alias("s")).where(F.size("s.redactions") > 0).select("key", F.col("s.text").alias("text"), F.size("s.redactions").alias("n")).distinct()
    return s.agg(F.count("*").alias("texts"), F.sum("n").alias("redactions"), F.sum(F.size(scan_text(F.col("text")))).alias("residual_hits"))


def scanner_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Hits by kind of the native scanner and of the Python one over the same texts, side by side."""
    udf.register_sql(spark)
    t = materialise(_texts(spark, d).select("text").where(F.col("text").rlike("[0-9@+]")).distinct(), "texts-to-scan")
    t.createOrReplaceTempView("veil_agreement_texts")
    native = t.select(F.inline(scan_text(F.col("text")))).groupBy(F.col("id").alias("kind")).agg(F.count("*").alias("native"))
    python = spark.sql("SELECT r.kind AS kind, count(*) AS python FROM veil_agreement_texts t, LATERAL scan_text_rows(t.text) r GROUP BY r.kind")
    return native.join(python, "kind", "full").fillna(0, ["native", "python"])


def resource_stream(spark: SparkSession, d: str) -> DataFrame:
    """Memory readings sampled by a stream: first, peak, last and growth of each session, kept up as readings come."""
    s = replay.stream_table(spark, d, "events").select(F.col("user_id").alias("session"), F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id").alias("at"), F.col("value").alias("used"))
    out = replay.last_of(replay.run_available(replay.resource_summary(s), "resources", "update"), "session")
    return out.select("session", F.col("samples").cast("bigint").alias("samples"), *(F.round(c, 6).alias(c) for c in ("first", "peak", "last", "delta")))


def digest_element_fields(spark: SparkSession, d: str) -> DataFrame:
    """Label and value of the elements of every page digest, scrubbed and cut."""
    e = digest.digest_elements(_written_elements(spark, d, "tag", "role", "href", "rect", *_EVIDENCE), _pages(spark, d))
    return e.select("page_id", "ord", "label", "value", "sensitive")


def digest_page_fields(spark: SparkSession, d: str) -> DataFrame:
    """Title and address of every page digest, scrubbed."""
    g = digest.build_digest(_written_elements(spark, d, "tag", "role", "href", "rect", *_EVIDENCE), _pages(spark, d))
    return g.select("page_id", "digest.url", "digest.title", F.col("digest.viewport.w").cast("bigint").alias("w"), F.col("digest.viewport.h").cast("bigint").alias("h"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        coord_values, viewport_contexts, iou_unclamped, release_v1, resolved_targets, frames_with_scans, latest_pages, body_previews, redacted_elements, rescan_after_scrub, scanner_agreement, resource_stream,
        digest_element_fields, digest_page_fields,
    )
}

_IOU_A = "(SELECT page_id AS frame_id, ord, rect.x AS x, rect.y AS y, rect.w - 60 AS w, rect.h AS h, rect.x + 5 AS x2, rect.w AS w2 FROM el)"
_RF = "(SELECT DISTINCT page_id * 100000000 + ord AS key, {c} AS text FROM elements WHERE {c} IS NOT NULL)"


def _scrubbed(name: str, key: str, source: str) -> str:
    """``scrubbed_sql`` as a CTE ``name(key, text)`` that can stand beside others."""
    return f"{name} AS ({scrubbed_sql(key, source)} SELECT {key}, text FROM e)"


_FIELDS = ("placeholder", "text", "value")
_INTER_KEY = "page_id * 100000000 + ord"
SQL: dict[str, str] = {
    "coord_values": vision._INPUTS
    + "SELECT page_id AS frame_id, ord, round(rect.x + scroll_x, 6) AS document_x, round(rect.y + scroll_y, 6) AS document_y, round(rect.w, 6) AS document_w, round(rect.h, 6) AS document_h, round(rect.x * dpr * s + (640 - width * s) / 2, 6) AS model_x, round(rect.y * dpr * s + (640 - height * s) / 2, 6) AS model_y, round(rect.w * dpr * s, 6) AS model_w, round(rect.h * dpr * s, 6) AS model_h FROM el JOIN (SELECT *, least(640 / width, 640 / height) AS s FROM frames) f ON page_id = frame_id",
    "viewport_contexts": "SELECT page_id, ok AS usable, CASE WHEN ok THEN CAST(page_id % 4 - 1 AS DOUBLE) END AS dpr, CASE WHEN ok THEN CASE WHEN page_id % 3 > 0 THEN CAST(page_id % 50 AS DOUBLE) ELSE 0.0::DOUBLE END END AS scroll_x, CASE WHEN ok THEN 0.0::DOUBLE END AS scroll_y, CASE WHEN ok THEN CAST(viewport_w AS BIGINT) END AS width, CASE WHEN ok THEN CAST(viewport_h AS BIGINT) END AS height FROM (SELECT *, page_id % 4 - 1 > 0 AS ok FROM page_index)",
    "iou_unclamped": vision._INPUTS
    + f"SELECT frame_id, ord, round(CASE WHEN u <> 0 THEN i / u ELSE 0.0 END, 9) + 0.0 AS iou FROM (SELECT *, w * h + w2 * h - i AS u FROM (SELECT *, greatest(0, least(x + w, x2 + w2) - greatest(x, x2)) * greatest(0, least(y + h, y + h) - greatest(y, y)) AS i FROM {_IOU_A}))",
    "release_v1": "SELECT frame_id, 'released' AS state, why FROM (" + vision.SQL["release_quarantine"] + ")",
    "resolved_targets": "WITH act AS ("
    + _ACT
    + "SELECT * FROM a), q AS (SELECT DISTINCT request_id, coalesce(dom_elements, []) AS els FROM requests), x AS (SELECT request_id, els[i] AS e, i - 1 AS pos FROM (SELECT *, unnest(range(1, len(els) + 1)) AS i FROM q)), t AS (SELECT a.request_id, min(CASE WHEN e.selector = a.selector OR '#' || e.id = a.selector OR '[name=\"' || e.name || '\"]' = a.selector OR e.tag = a.selector THEN pos END) AS n, max(CASE WHEN a.x >= e.rect.left AND a.x < e.rect.left + e.rect.width AND a.y >= e.rect.top AND a.y < e.rect.top + e.rect.height THEN pos END) AS p FROM act a LEFT JOIN x ON x.request_id = a.request_id GROUP BY a.request_id) SELECT a.request_id, type, selector, x, y, CAST(coalesce(n, p) AS INT) AS \"at\", CASE WHEN n IS NOT NULL THEN 'selector' WHEN p IS NOT NULL THEN 'point' END AS how FROM act a JOIN t USING (request_id)",
    "frames_with_scans": vision._INPUTS
    + "SELECT f.frame_id, dpr, dn AS dom_boxes, dk AS dom_kinds, mn AS model_boxes, mt AS model_top FROM frames f LEFT JOIN (SELECT frame_id, count(*) AS dn, count(DISTINCT kind) AS dk FROM dom GROUP BY frame_id) USING (frame_id) LEFT JOIN (SELECT frame_id, count(*) AS mn, round(CAST(max(score) AS DOUBLE), 6) AS mt FROM model GROUP BY frame_id) USING (frame_id)",
    "latest_pages": "SELECT site, page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY first_seen DESC NULLS LAST, page_id DESC) AS n FROM page_index WHERE NOT regexp_matches(url, '^(chrome|edge|about|moz-extension|chrome-extension):')) WHERE n = 1",
    "body_previews": "SELECT DISTINCT request_id, substr(body, 1, 4000) AS shown, CAST(greatest(length(body) - 4000, 0) AS BIGINT) AS more FROM act_payloads",
    "redacted_elements": "WITH "
    + ", ".join(_scrubbed(f"s_{c}", "key", _RF.format(c=c)) for c in _FIELDS)
    + ", el AS (SELECT DISTINCT page_id, ord, type, placeholder, text, value FROM elements), r AS (SELECT el.page_id, el.ord, el.placeholder AS p0, el.text AS t0, el.value AS v0, coalesce(sp.text, el.placeholder) AS placeholder, coalesce(st.text, el.text) AS text, CASE WHEN coalesce(type = 'password', false) AND el.value IS NOT NULL THEN '[REDACTED:FIELD]' ELSE coalesce(sv.text, el.value) END AS value FROM el LEFT JOIN s_placeholder sp ON sp.key = page_id * 100000000 + ord LEFT JOIN s_text st ON st.key = page_id * 100000000 + ord LEFT JOIN s_value sv ON sv.key = page_id * 100000000 + ord) SELECT page_id, ord, placeholder, text, value FROM r WHERE placeholder IS DISTINCT FROM p0 OR text IS DISTINCT FROM t0 OR value IS DISTINCT FROM v0",
    "rescan_after_scrub": f"WITH once AS ({scrubbed_sql('key', _T)} SELECT key, text, n FROM e) SELECT count(*) AS texts, CAST(sum(n) AS BIGINT) AS redactions, (SELECT count(*) FROM ({hits_sql('key', 'once')})) AS residual_hits FROM once",
    "scanner_agreement": f"SELECT id AS kind, count(*) AS native, count(*) AS python FROM ({hits_sql('key', '(SELECT DISTINCT text, text AS key FROM ' + _T + ')')}) GROUP BY id",
    "resource_stream": "SELECT user_id AS session, count(*) AS samples, round(arg_min(value, (ts, event_id)), 6) AS first, round(max(value), 6) AS peak, round(arg_max(value, (ts, event_id)), 6) AS last, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 6) AS delta FROM events WHERE value > 0 GROUP BY user_id",
    "digest_element_fields": "WITH "
    + _BASE
    + ", "
    + _scrubbed("s_hay", "key", f"(SELECT {_INTER_KEY} AS key, haystack AS text FROM inter JOIN (SELECT page_id, ord, haystack FROM hay) USING (page_id, ord))")
    + ", "
    + _scrubbed("s_val", "key", f"(SELECT {_INTER_KEY} AS key, value AS text FROM inter WHERE length(value) BETWEEN 1 AND 99)")
    + " SELECT n.page_id, n.ord, nullif(substr(coalesce(sh.text, k.haystack), 1, 120), '') AS label, CASE WHEN layer IS NOT NULL THEN '[REDACTED:FIELD]' WHEN length(n.value) BETWEEN 1 AND 99 THEN coalesce(sv.text, n.value) END AS value, layer IS NOT NULL AS sensitive FROM inter n JOIN cls k ON k.page_id = n.page_id AND k.ord = n.ord LEFT JOIN s_hay sh ON sh.key = n.page_id * 100000000 + n.ord LEFT JOIN s_val sv ON sv.key = n.page_id * 100000000 + n.ord",
    "digest_page_fields": "WITH "
    + _BASE
    + ", "
    + _scrubbed("s_url", "page_id", "(SELECT page_id, url AS text FROM page_index WHERE url IS NOT NULL)")
    + ", "
    + _scrubbed("s_title", "page_id", "(SELECT page_id, page_title AS text FROM page_index WHERE page_title IS NOT NULL)")
    + " SELECT p.page_id, coalesce(u.text, p.url) AS url, coalesce(t.text, p.page_title) AS title, CAST(viewport_w AS BIGINT) AS w, CAST(viewport_h AS BIGINT) AS h FROM page_index p LEFT JOIN s_url u USING (page_id) LEFT JOIN s_title t USING (page_id) WHERE page_id IN (SELECT page_id FROM inter)",
}
