"""Queries of the core training-data operators (p1 and p2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import measures, nested
from ..session import shared_dir, spread
from .tables import table


def _placed(spark: SparkSession, d: str, viewports: bool = False) -> DataFrame:
    clients = table(spark, d, "clients")
    return measures.place_requests(table(spark, d, "requests"), clients, viewports).unionByName(measures.place_bodies(spread(table(spark, d, "act_payloads")), clients, viewports=viewports))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return measures.matching_boxes(_placed(spark, d))


def p1_placed(spark: SparkSession, d: str) -> DataFrame:
    """Every rect, box and viewport in CSS px, rounded to a thousandth."""
    return _placed(spark, d, viewports=True).select("request_id", "kind", "path", *(F.round(n, 3).alias(n) for n in ("left", "top", "width", "height"))).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The links of all nodes of bodies, from the tables written by tag."""
    path = shared_dir(spark, "nested-bodies")
    nested.write_tables(nested.emit_tagged(spread(table(spark, d, "act_payloads"))), path)
    return nested.links_of(spark, path, "element", "rect", "redaction")


def _nodes(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """One of the tables of bodies and parsed requests, through the tables written by tag."""
    path = shared_dir(spark, "nested")
    nested.write_tables(nested.emit_tagged(spread(table(spark, d, "act_payloads"))).unionByName(nested.emit_arrays(spread(table(spark, d, "requests")))), path)
    return nested.read_table(spark, path, kind).distinct()


def p2_requests(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, "request")


def p2_elements(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, "element")


def p2_rects(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, "rect")


def p2_redactions(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, "redaction")


def p2_request_links(spark: SparkSession, d: str) -> DataFrame:
    return nested.distinct_nodes(nested.flatten_arrays(table(spark, d, "requests").select("request_id", "dom_elements", "redaction_manifest")), with_fields=True)


def _decoded(x: str) -> str:
    """JSON ``x``, or what it holds if it is JSON of an object or array in a string, two layers deep."""
    once = lambda x: f"(CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches({x} ->> '$', '^\\s*[\\[{{\"]') AND json_valid({x} ->> '$') THEN CAST({x} ->> '$' AS JSON) ELSE {x} END)"
    return once(once(x))


def _entries_sql(columns: str, value: str, source: str) -> str:
    """(columns, pos, e) of the objects of an array; a lone object is at 0."""
    arrays = f"SELECT {columns}, CASE WHEN json_type(d) = 'ARRAY' THEN json_extract(d, '$[*]') ELSE [d] END AS l FROM (SELECT {columns}, {_decoded(value)} AS d FROM {source})"
    return f"SELECT {columns}, pos, {_decoded('raw')} AS e FROM (SELECT {columns}, unnest(l) AS raw, unnest(range(len(l))) AS pos FROM ({arrays})) WHERE json_type({_decoded('raw')}) = 'OBJECT'"


_IS_REQUEST = "(json_type(v) = 'OBJECT' AND (" + " OR ".join(f"json_exists(v, '$.{f}')" for f in ("dom_elements", "redaction_manifest", "task", "viewport")) + "))"
#: req(k, request_id, r): the request of every readable body; el(k, request_id, path, parent, e): its elements of any depth; red: its redaction items.
_BODIES = f"""WITH RECURSIVE b AS (SELECT row_number() OVER () AS k, request_id, {_decoded('CAST(body AS JSON)')} AS v FROM (SELECT DISTINCT request_id, body FROM act_payloads WHERE json_valid(body))),
look AS (SELECT k, request_id, v, 0 AS depth, 0 AS place FROM b UNION ALL SELECT k, request_id, {_decoded('c')}, depth + 1, place * 1000 + i FROM (SELECT k, request_id, depth, place, unnest(l) AS c, unnest(range(len(l))) AS i FROM (SELECT *, CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]') ELSE json_extract(v, '$.*') END AS l FROM look WHERE json_type(v) IN ('ARRAY', 'OBJECT') AND NOT {_IS_REQUEST}))),
req AS (SELECT k, request_id, arg_min(v, (depth, place)) AS r FROM look WHERE {_IS_REQUEST} GROUP BY k, request_id),
el AS (SELECT k, request_id, CAST(pos AS VARCHAR) AS path, '' AS parent, e FROM ({_entries_sql('k, request_id', "json_extract(r, '$.dom_elements')", 'req')})
  UNION ALL SELECT k, request_id, path || '.' || pos, path, e FROM ({_entries_sql('k, request_id, path', "json_extract(e, '$.children')", 'el')})),
red AS (SELECT request_id, path || '/' || pos AS path, path AS parent, e FROM ({_entries_sql('k, request_id, path', "json_extract(e, '$.redaction_manifest')", 'el')})
  UNION ALL SELECT request_id, CAST(pos AS VARCHAR), '', e FROM ({_entries_sql('k, request_id', "json_extract(r, '$.redaction_manifest')", 'req')}))
"""
_PARSED = "q AS (SELECT request_id, unnest({0}) AS e, unnest(range(len({0}))) AS pos FROM requests)"
_ELEMENT_TEXTS = ("tag", "id", "name", "type", "text", "selector")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_placed, p2_found, p2_requests, p2_elements, p2_rects, p2_redactions, p2_request_links)}
SQL: dict[str, str] = {
    "p2_found": _BODIES
    + """SELECT request_id, 'element' AS node_kind, path AS node_path, parent AS parent_path FROM el UNION SELECT request_id, 'rect', path || '/rect', path FROM el WHERE json_type(json_extract(e, '$.rect')) <> 'NULL'
UNION SELECT request_id, 'redaction', path, parent FROM red""",
    "p2_elements": _BODIES
    + ", "
    + _PARSED.format("dom_elements")
    + " SELECT request_id, path AS node_path, parent AS parent_path, "
    + ", ".join(f"e ->> '$.{f}' AS {f}" for f in _ELEMENT_TEXTS)
    + ", CASE WHEN json_type(json_extract(e, '$.is_interactive')) = 'BOOLEAN' THEN CAST(json_extract(e, '$.is_interactive') AS BOOLEAN) END AS is_interactive FROM el UNION SELECT request_id, CAST(pos AS VARCHAR), '', "
    + ", ".join(f"e.{f}" for f in (*_ELEMENT_TEXTS, "is_interactive"))
    + " FROM q WHERE e IS NOT NULL",
    "p2_request_links": """WITH el AS (SELECT request_id, unnest(dom_elements) AS e, unnest(range(len(dom_elements))) AS pos FROM requests),
m AS (SELECT request_id, unnest(redaction_manifest) AS e, unnest(range(len(redaction_manifest))) AS pos FROM requests)
SELECT DISTINCT request_id, 'element' AS node_kind, CAST(pos AS VARCHAR) AS node_path, '' AS parent_path FROM el WHERE e IS NOT NULL
UNION ALL SELECT DISTINCT request_id, 'rect', pos || '/rect', CAST(pos AS VARCHAR) FROM el WHERE e.rect IS NOT NULL
UNION ALL SELECT DISTINCT request_id, 'redaction', CAST(pos AS VARCHAR), '' FROM m WHERE e IS NOT NULL""",
}
