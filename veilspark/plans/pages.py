"""Queries of element classification, page digests and action ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import elements as E
from ..functions.patterns import AUTOCOMPLETE_TOKENS, AUTOCOMPLETE_TOKENS_V1, NAME_PATTERN_V1, NAME_REGEX
from ..operators import actions, digest
from ..session import materialise, spread
from .sqlgen import hits_sql, scrubbed_sql
from .tables import table


#: What the classifier reads of an element besides its key.
_EVIDENCE = ("type", "name", "id", "placeholder", "aria_label", "data_testid", "data_test", "aria_labelledby", "autocomplete", "value", "text")


def _elements(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The elements' last loads, with the named columns only: the others are neither read nor shuffled."""
    return digest.latest(spread(table(spark, d, "elements").select("page_id", "ord", "loaded_at", *columns)), columns)


def _written_elements(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The same, written once for those who read them several times."""
    return materialise(_elements(spark, d, *columns), "elements")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_index")


def haystacks(spark: SparkSession, d: str) -> DataFrame:
    return digest.with_haystack(_written_elements(spark, d, *(c for c in _EVIDENCE if c not in ("type", "autocomplete", "value")))).where("haystack <> ''").select("page_id", "ord", "haystack")


def element_classes(spark: SparkSession, d: str) -> DataFrame:
    return digest.classified(_written_elements(spark, d, *_EVIDENCE)).where("class IS NOT NULL").select("page_id", "ord", "class.*")


def layer_counts(spark: SparkSession, d: str) -> DataFrame:
    return element_classes(spark, d).groupBy("layer").agg(F.count("*").alias("n"))


def element_classes_v1(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d, "type", "autocomplete", "name", "id", "placeholder", "aria_label").select("page_id", "ord", E.classify_v1(digest.attribute).alias("v"))
    return e.select("page_id", "ord", "v.*")


def labelled_elements(spark: SparkSession, d: str) -> DataFrame:
    return digest.labelled_by(_elements(spark, d, "id", "aria_labelledby", "text")).select("page_id", "ord", F.array_join("labels", " | ").alias("labels"))


def pointed_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels that point to an element: here the label elements, each pointing to the id of the element after it."""
    e = _written_elements(spark, d, "tag", "id", "text")
    labels = e.where("tag = 'label'").select("page_id", (F.col("ord") + 1).alias("ord"), "text").join(e.where("id <> ''").select("page_id", "ord", F.col("id").alias("for_id")), ["page_id", "ord"])
    return digest.labels_for(e, labels).select("page_id", "ord", F.array_join("labels", " | ").alias("labels"))


def field_boxes(spark: SparkSession, d: str) -> DataFrame:
    return digest.field_boxes(_written_elements(spark, d, "tag", "rect", "hidden", *_EVIDENCE), _pages(spark, d)).select("page_id", "ord", "layer", "kind", "visible")


def text_boxes_first400(spark: SparkSession, d: str) -> DataFrame:
    return digest.text_boxes(_elements(spark, d, "tag", "text", "rect"), _pages(spark, d)).select("page_id", "ord", "kind", "confidence")


def full_scan_by_layer(spark: SparkSession, d: str) -> DataFrame:
    return digest.full_scan(_written_elements(spark, d, "tag", "rect", "hidden", *_EVIDENCE), _pages(spark, d)).groupBy("layer", "kind").agg(F.count("*").alias("n"))


def sensitive_elements_v1(spark: SparkSession, d: str) -> DataFrame:
    return digest.sensitive_elements_v1(_elements(spark, d, "tag", "rect", "type", "autocomplete", "name", "id", "placeholder", "aria_label")).select("page_id", "ord", "reason")


def interactive_elements_v1(spark: SparkSession, d: str) -> DataFrame:
    return digest.interactive_elements_v1(_elements(spark, d, "tag", "type", "id", "name", "placeholder", "aria_label", "value", "text", "rect"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return _elements(spark, d, "tag", "href").where("tag = 'a' AND href IS NOT NULL").select("page_id", "ord", "href")


def page_headings(spark: SparkSession, d: str) -> DataFrame:
    return digest.digest_headings(_elements(spark, d, "tag", "text")).select("page_id", "ord", "heading", F.col("n").cast("bigint").alias("n"))


def digest_elements_top150(spark: SparkSession, d: str) -> DataFrame:
    e = digest.digest_elements(_written_elements(spark, d, "tag", "role", "href", "rect", *_EVIDENCE), _pages(spark, d))
    return e.select("page_id", "ord", F.col("i").cast("bigint").alias("i"), "tag", "type", "role", "text", "sensitive", "pii_kind", *(F.col(f"rect.{n}").alias(n) for n in "xywh"))


def page_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digests as JSON, one row per page."""
    return digest.build_digest(_written_elements(spark, d, "tag", "role", "href", "rect", *_EVIDENCE), _pages(spark, d)).select("page_id", F.to_json("digest").alias("digest"), F.to_json("stats").alias("stats"))


def digest_sizes(spark: SparkSession, d: str) -> DataFrame:
    g = digest.build_digest(_written_elements(spark, d, "tag", "role", "href", "rect", *_EVIDENCE), _pages(spark, d))
    return g.select("page_id", F.size("digest.elements").cast("bigint").alias("elements"), F.size("digest.headings").cast("bigint").alias("headings"), F.coalesce(F.element_at("stats.by_kind", "field"), F.lit(0)).cast("bigint").alias("fields"))


def reachable_pages(spark: SparkSession, d: str) -> DataFrame:
    return digest.reachable_urls(_pages(spark, d).select("page_id", "url"))


def request_actions(spark: SparkSession, d: str) -> DataFrame:
    return actions.act(table(spark, d, "requests")).distinct()


def action_counts(spark: SparkSession, d: str) -> DataFrame:
    return request_actions(spark, d).groupBy("type").agg(F.count("*").alias("n"))


def task_keywords(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "requests").select("request_id", F.posexplode(actions.keywords(F.col("task"))).alias("at", "word")).distinct()
    return k.groupBy("word").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        haystacks, element_classes, layer_counts, element_classes_v1, labelled_elements, pointed_labels, field_boxes, text_boxes_first400, full_scan_by_layer, sensitive_elements_v1,
        interactive_elements_v1, page_links, page_headings, digest_elements_top150, page_digests, digest_sizes, reachable_pages, request_actions, action_counts, task_keywords,
    )
}


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_PARTS = "[nullif(name, ''), nullif(id, ''), nullif(placeholder, ''), nullif(aria_label, ''), nullif(data_testid, ''), nullif(data_test, '')]"
_N = NAME_REGEX.replace("'", "''")
_BASE = f"""el AS (SELECT DISTINCT * EXCLUDE (loaded_at, seen_at) FROM elements),
refs AS (SELECT page_id, ord, r[i] AS rid, i AS n FROM (SELECT page_id, ord, r, unnest(range(1, len(r) + 1)) AS i FROM (SELECT page_id, ord, list_filter(string_split_regex(aria_labelledby, '\\s+'), lambda x: x <> '') AS r FROM el WHERE trim(aria_labelledby) <> ''))),
firsts AS (SELECT page_id, id AS rid, arg_min(coalesce(text, ''), ord) AS t FROM el WHERE id <> '' GROUP BY page_id, id),
bylab AS (SELECT page_id, ord, list(t ORDER BY n) AS labels FROM refs JOIN firsts USING (page_id, rid) GROUP BY page_id, ord),
hay AS (SELECT el.*, substr(array_to_string(list_filter(list_concat({_PARTS}, coalesce(list_transform(labels, lambda x: nullif(x, '')), [])), lambda x: x IS NOT NULL), ' '), 1, 500) AS haystack FROM el LEFT JOIN bylab USING (page_id, ord)),
vals AS (SELECT page_id, ord, arg_min(id, idx * 100 + ord_) AS vid, arg_min(confidence, idx * 100 + ord_) AS vconf FROM (SELECT page_id, eord AS ord, idx, ord AS ord_, id, confidence FROM ({hits_sql('page_id, eord', "(SELECT page_id, ord AS eord, value AS text FROM el WHERE length(value) > 3)")})) GROUP BY page_id, ord),
tok AS (SELECT *, list_filter({_list(AUTOCOMPLETE_TOKENS)}, lambda t: list_contains(string_split_regex(lower(autocomplete), '\\s+'), t) OR t = lower(autocomplete))[1] AS token, regexp_extract(haystack, '{_N}', 0, 'i') AS nm FROM hay),
cls AS (SELECT tok.*, CASE WHEN lower(type) = 'password' THEN 'L1' WHEN token IS NOT NULL THEN 'L2' WHEN nm <> '' THEN 'L3' WHEN vid IS NOT NULL THEN 'L4' END AS layer,
  CASE WHEN lower(type) = 'password' THEN 1.0::DOUBLE WHEN token IS NOT NULL THEN 0.95::DOUBLE WHEN nm <> '' THEN 0.8::DOUBLE ELSE vconf END AS confidence,
  CASE WHEN lower(type) = 'password' THEN 'password' WHEN token IS NOT NULL THEN token WHEN nm <> '' THEN lower(nm) ELSE vid END AS kind,
  CASE WHEN lower(type) = 'password' THEN 'type="password"' WHEN token IS NOT NULL THEN 'autocomplete="' || token || '"' WHEN nm <> '' THEN 'label/name matched "' || nm || '"' ELSE 'value matched ' || vid END AS reason FROM tok LEFT JOIN vals USING (page_id, ord)),
v1 AS (SELECT *, list_filter({_list(AUTOCOMPLETE_TOKENS_V1)}, lambda t: contains(lower(coalesce(autocomplete, '')), t))[1] AS tok1, array_to_string(list_filter([nullif(name, ''), nullif(id, ''), nullif(placeholder, ''), nullif(aria_label, '')], lambda x: x IS NOT NULL), ' ') AS hay1 FROM el),
w1 AS (SELECT *, CASE WHEN lower(type) = 'password' THEN 'type=password' WHEN tok1 IS NOT NULL THEN 'autocomplete=' || tok1 WHEN regexp_matches(hay1, '{NAME_PATTERN_V1}', 'i') THEN 'name/label match: "' || hay1 || '"' END AS reason1 FROM v1),
fb AS (SELECT c.*, coalesce(rect.w > 0 AND rect.h > 0 AND rect.y + rect.h >= 0 AND rect.y <= viewport_h AND NOT coalesce(hidden, false) AND rect.x + rect.w >= 0 AND rect.x <= viewport_w, false) AS visible FROM cls c JOIN page_index USING (page_id) WHERE layer IS NOT NULL AND tag IN ('input', 'textarea', 'select')),
trimmed AS (SELECT *, regexp_replace(text, '^[\\s\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{0085}}]+|[\\s\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{0085}}]+$', '', 'g') AS tt FROM el),
nodes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS rn FROM trimmed WHERE length(tt) >= 6 AND NOT coalesce(lower(tag) IN ('script', 'style', 'noscript'), false)) WHERE rn <= 400),
tb AS (SELECT h.page_id, h.eord AS ord, h.id AS kind, h.confidence FROM ({hits_sql('page_id, eord', '(SELECT page_id, ord AS eord, text FROM nodes)')}) h JOIN el e ON e.page_id = h.page_id AND e.ord = h.eord JOIN page_index p ON p.page_id = h.page_id WHERE rect.w > 0 AND rect.h > 0 AND rect.y + rect.h >= 0 AND rect.y <= viewport_h),
inter AS (SELECT * FROM (SELECT t.*, row_number() OVER (PARTITION BY t.page_id ORDER BY t.ord) - 1 AS i FROM trimmed t JOIN page_index p ON p.page_id = t.page_id WHERE (tag IN ('button', 'input', 'textarea', 'select') OR role IN ('button', 'link', 'textbox') OR (tag = 'a' AND href IS NOT NULL)) AND rect.w > 0 AND rect.h > 0 AND rect.y + rect.h >= 0 AND rect.y <= viewport_h) WHERE i < 150)
"""
_WITH = "WITH " + _BASE
_SCRUB_INTER = scrubbed_sql("key", "(SELECT page_id * 100000000 + ord AS key, tt AS text FROM inter WHERE tt <> '')").removeprefix("WITH ")
_SCRUB_HEAD = scrubbed_sql("key", "(SELECT page_id * 100000000 + ord AS key, tt AS text FROM trimmed WHERE tag IN ('h1', 'h2', 'h3') AND tt <> '')").removeprefix("WITH ")
_HEADS = _WITH + ", " + _SCRUB_HEAD + ", hd AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS n FROM (SELECT t.page_id, t.ord, substr(coalesce(e.text, tt), 1, 100) AS heading FROM trimmed t LEFT JOIN e ON e.key = t.page_id * 100000000 + t.ord WHERE tag IN ('h1', 'h2', 'h3') AND tt <> ''))"
_ACT = """WITH q AS (SELECT DISTINCT request_id, coalesce(task, '') AS task, lower(coalesce(task, '')) AS low, list_filter(coalesce(dom_elements, []), lambda e: e IS NOT NULL) AS els, coalesce(len(redaction_manifest), 0) AS regions, coalesce(length(sanitized_image_base64), 0) AS image FROM requests),
k AS (SELECT *, regexp_extract_all(low, '[\\p{L}\\p{N}\\p{M}_]{3,}') AS words, regexp_extract(task, '(?:fill|enter|type|input)\\s+([a-zA-Z0-9_\\s]+?)(?:\\s+with|\\s+as|\\s*:\\s*)\\s*(.*)', ['f', 'v'], 'i') AS tm FROM q),
ex AS (SELECT request_id, words, els[i] AS e, i, tm FROM (SELECT *, unnest(range(1, len(els) + 1)) AS i FROM k)),
sc AS (SELECT *, 2 * len(list_filter(words, lambda w: w NOT IN ('click', 'press', 'the', 'button') AND contains(lower(coalesce(e.text, '') || ' ' || coalesce(e.id, '') || ' ' || coalesce(e.name, '') || ' ' || coalesce(e.selector, '')), w))) + CASE WHEN coalesce(e.tag IN ('button', 'a'), false) OR coalesce(e.type = 'submit', false) THEN 1 ELSE 0 END AS score,
  len(list_filter(list_filter(string_split_regex(lower(trim(tm.f)), '\\s+'), lambda p: p <> ''), lambda p: contains(lower(coalesce(e.name, '') || ' ' || coalesce(e.id, '') || ' ' || coalesce(e.text, '') || ' ' || coalesce(e.selector, '')), p))) > 0 AS holds FROM ex),
best AS (SELECT request_id, max(score) AS top, arg_min(e, (1000 - score) * 100000 + i) AS b, min(CASE WHEN holds THEN i END) AS fi, min(CASE WHEN e.tag = 'button' OR e.type = 'submit' THEN i END) AS di FROM sc GROUP BY request_id),
j AS (SELECT k.*, top, b, els[fi] AS f, els[di] AS d, low LIKE '%scroll down%' AS down, low LIKE '%scroll up%' AS up, regexp_matches(low, 'click|press|submit|confirm|authenticate|login|button') AND coalesce(top, 0) > 0 AS click, fi IS NOT NULL AND regexp_matches(task, '(?:fill|enter|type|input)\\s+([a-zA-Z0-9_\\s]+?)(?:\\s+with|\\s+as|\\s*:\\s*)\\s*(.*)', 'i') AS typ FROM k LEFT JOIN best USING (request_id)),
a AS (SELECT request_id, CASE WHEN down OR up THEN 'scroll' WHEN click THEN 'click' WHEN typ THEN 'type' WHEN d IS NOT NULL THEN 'click' ELSE 'finish' END AS type,
  CASE WHEN down OR up THEN NULL WHEN click THEN coalesce(nullif(b.selector, ''), '#' || nullif(b.id, ''), b.tag) WHEN typ THEN f.selector WHEN d IS NOT NULL THEN coalesce(nullif(d.selector, ''), '#' || nullif(d.id, ''), d.tag) END AS selector,
  CASE WHEN down OR up THEN 0 WHEN click THEN CASE WHEN b.rect IS NOT NULL THEN CAST(trunc(coalesce(b.rect.left, 0) + coalesce(b.rect.width, 0) / 2) AS INT) END WHEN typ THEN NULL WHEN d.rect IS NOT NULL THEN CAST(trunc(coalesce(d.rect.left, 100)) AS INT) END AS x,
  CASE WHEN down THEN 500 WHEN up THEN -500 WHEN click THEN CASE WHEN b.rect IS NOT NULL THEN CAST(trunc(coalesce(b.rect.top, 0) + coalesce(b.rect.height, 0) / 2) AS INT) END WHEN typ THEN NULL WHEN d.rect IS NOT NULL THEN CAST(trunc(coalesce(d.rect.top, 100)) AS INT) END AS y,
  CASE WHEN NOT (down OR up) AND NOT click AND typ THEN trim(tm.v) END AS value,
  CAST(CASE WHEN down OR up THEN 0.95 WHEN click THEN least(0.75::DOUBLE + top * 0.08::DOUBLE, 0.99::DOUBLE) WHEN typ THEN 0.92 WHEN d IS NOT NULL THEN 0.8 ELSE 0.5 END AS DOUBLE) AS confidence, CAST(regions AS INT) AS redacted_regions, CAST(image AS INT) AS image_chars, image > 100 AS has_image FROM j)
"""
SQL: dict[str, str] = {
    "haystacks": _WITH + "SELECT page_id, ord, haystack FROM hay WHERE haystack <> ''",
    "element_classes": _WITH + "SELECT page_id, ord, layer, confidence, kind, reason FROM cls WHERE layer IS NOT NULL",
    "layer_counts": _WITH + "SELECT layer, count(*) AS n FROM cls WHERE layer IS NOT NULL GROUP BY layer",
    "element_classes_v1": _WITH + "SELECT page_id, ord, reason1 IS NOT NULL AS sensitive, reason1 AS reason FROM w1",
    "labelled_elements": _WITH + "SELECT page_id, ord, array_to_string(labels, ' | ') AS labels FROM bylab",
    "pointed_labels": _WITH + "SELECT t.page_id, t.ord, string_agg(coalesce(l.text, ''), ' | ' ORDER BY l.ord) AS labels FROM el l JOIN el s ON s.page_id = l.page_id AND s.ord = l.ord + 1 AND s.id <> '' JOIN el t ON t.page_id = s.page_id AND t.id = s.id WHERE l.tag = 'label' GROUP BY t.page_id, t.ord",
    "field_boxes": _WITH + "SELECT page_id, ord, layer, kind, visible FROM fb",
    "text_boxes_first400": _WITH + "SELECT page_id, ord, kind, confidence FROM tb",
    "full_scan_by_layer": _WITH + "SELECT layer, kind, count(*) AS n FROM (SELECT layer, kind FROM fb WHERE visible UNION ALL SELECT 'L4', kind FROM tb) GROUP BY ALL",
    "sensitive_elements_v1": _WITH + "SELECT page_id, ord, reason1 AS reason FROM w1 WHERE reason1 IS NOT NULL AND tag IN ('input', 'textarea', 'select') AND rect.w <> 0 AND rect.h <> 0",
    "interactive_elements_v1": _WITH + "SELECT page_id, ord, tag, coalesce(id, '') AS id, coalesce(name, '') AS name, type, substr(coalesce(nullif(tt, ''), nullif(value, ''), nullif(placeholder, ''), nullif(aria_label, ''), ''), 1, 80) AS text, coalesce('#' || nullif(id, ''), CASE WHEN name <> '' THEN '[name=\"' || name || '\"]' END, tag) AS selector, " + ", ".join(f"CAST(floor(rect.{c} + 0.5) AS BIGINT) AS {c}" for c in "xywh") + " FROM trimmed WHERE tag IN ('a', 'button', 'input', 'textarea', 'select') AND rect.w <> 0 AND rect.h <> 0",
    "page_links": "SELECT DISTINCT page_id, ord, href FROM elements WHERE tag = 'a' AND href IS NOT NULL",
    "page_headings": _HEADS + " SELECT page_id, ord, heading, n FROM hd WHERE n <= 20",
    "digest_elements_top150": _WITH + ", " + _SCRUB_INTER + " SELECT n.page_id, n.ord, n.i, n.tag, nullif(n.type, '') AS type, nullif(n.role, '') AS role, nullif(substr(coalesce(e.text, n.tt), 1, 120), '') AS text, layer IS NOT NULL AS sensitive, CASE WHEN layer IS NOT NULL THEN kind END AS pii_kind, " + ", ".join(f"CAST(floor(n.rect.{c} + 0.5) AS BIGINT) AS {c}" for c in "xywh") + " FROM inter n JOIN cls k ON k.page_id = n.page_id AND k.ord = n.ord LEFT JOIN e ON e.key = n.page_id * 100000000 + n.ord",
    "digest_sizes": _HEADS + " SELECT n.page_id, count(*) AS elements, any_value(coalesce(h, 0)) AS headings, CAST(count_if(layer IS NOT NULL) AS BIGINT) AS fields FROM inter n JOIN cls k ON k.page_id = n.page_id AND k.ord = n.ord LEFT JOIN (SELECT page_id, count(*) AS h FROM hd WHERE n <= 20 GROUP BY page_id) x ON x.page_id = n.page_id GROUP BY n.page_id",
    "reachable_pages": "SELECT page_id, url FROM page_index WHERE NOT regexp_matches(url, '^(chrome|edge|about|moz-extension|chrome-extension):')",
    "request_actions": _ACT + "SELECT * FROM a",
    "action_counts": _ACT + "SELECT type, count(*) AS n FROM a GROUP BY type",
    "task_keywords": "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(task), '[\\p{L}\\p{N}\\p{M}_]{3,}')) AS word FROM (SELECT DISTINCT request_id, task FROM requests)) GROUP BY word",
}
