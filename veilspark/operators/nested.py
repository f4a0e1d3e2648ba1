"""Deeply nested semi-structured records into flat, linked tables by single-pass tagged emission.

A depth-first visitor walks each body once and emits one row per node: its
table tag, its key, its parent's key and its own fields as JSON. The rows of
all tables share one schema, so one pass over the input feeds them all;
:func:`write_tables` stores them partitioned by tag and :func:`read_table`
gives one tag its typed schema back.

Defined results
---------------
* A body that is null, blank, not valid JSON (``NaN`` and ``Infinity``
  included), nested beyond the parser's depth, or without a request in it
  emits a single ``unreadable`` row with path ``''``; it gives no other node.
* The request may sit at any depth within outer objects (the shallowest object
  with a request field counts), and any structure may be JSON in a string.
* A lone object in place of an array has position 0; null entries keep their
  position and emit nothing; entries that are no objects emit nothing.
* Deliveries repeated with the same content give the same rows, once, after
  :func:`distinct_nodes`.
* Only ``key`` and ``body`` columns are read; any other column may be there.
* Parsed requests (:func:`emit_arrays`) give rows of the same shape, so one
  set of tables serves both. Absent and null fields are null in either.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("request", "element", "rect", "redaction", "unreadable")
TAGGED = "request_id BIGINT, node_kind STRING, node_path STRING, parent_path STRING, fields STRING"
#: Typed schema of each table's fields; values of varying shape stay JSON text.
SCHEMAS = {
    "request": "task STRING, url STRING, viewport STRING, units STRING, capture_note STRING, session_id STRING, client STRING, sent_at STRING, sanitized_image_base64 STRING",
    "element": "tag STRING, id STRING, name STRING, type STRING, text STRING, selector STRING, is_interactive BOOLEAN",
    "rect": "value STRING",
    "redaction": "source STRING, label STRING, box STRING, unit STRING",
    "unreadable": "problem STRING",
}
_REQUEST_FIELDS = ("dom_elements", "redaction_manifest", "task", "viewport")
_NESTED = {"children", "rect", "redaction_manifest"}
_DECODER = json.JSONDecoder(parse_constant=lambda x: (_ for _ in ()).throw(ValueError(x)))


def decode(value: Any) -> Any:
    """``value``, or what it holds if it is JSON of an object or array in a string (at any number of layers)."""
    while isinstance(value, str) and (v := value.strip())[:1] in ("{", "[", '"'):
        try:
            value = _DECODER.decode(v)
        except (ValueError, RecursionError):
            break
    return value


def parse_body(body: str | None) -> dict | None:
    """The request within a body, or ``None`` if the body isn't readable."""
    if body is None:
        return None
    try:
        value = decode(_DECODER.decode(body.strip()))
    except (ValueError, RecursionError):
        return None
    level = [value]
    while level:
        for x in level:
            if isinstance(x, dict) and any(f in x for f in _REQUEST_FIELDS):
                return x
        level = [decode(y) for x in level for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())]
    return None


def entries(value: Any) -> Iterator[tuple[int, dict]]:
    """(position, object) of an array's objects; a lone object is at 0."""
    value = decode(value)
    for at, x in enumerate(value if isinstance(value, list) else [value]):
        if isinstance(x := decode(x), dict):
            yield at, x


def visit(request: dict) -> Iterator[tuple[str, str, str, dict]]:
    """(tag, path, parent path, node) depth first. A rect's node is ``{"value": ..., "element": ...}``."""
    yield "request", "", "", request
    for at, item in entries(request.get("redaction_manifest")):
        yield "redaction", str(at), "", item
    stack = [(str(at), "", e) for at, e in entries(request.get("dom_elements"))][::-1]
    while stack:
        path, parent, element = stack.pop()
        yield "element", path, parent, element
        if element.get("rect") is not None:
            yield "rect", f"{path}/rect", path, {"value": element["rect"], "element": element}
        for at, item in entries(element.get("redaction_manifest")):
            yield "redaction", f"{path}/{at}", path, item
        stack.extend([(f"{path}.{at}", path, e) for at, e in entries(element.get("children"))][::-1])


def _text(value: Any) -> Any:
    return value if value is None or isinstance(value, (str, bool)) else json.dumps(value, ensure_ascii=False)


_FIELDS = {tag: [x.split()[0] for x in schema.split(", ")] for tag, schema in SCHEMAS.items()}


def _emit(key: int, body: str | None, with_fields: bool) -> Iterator[tuple]:
    request = parse_body(body)
    if request is None:
        yield key, "unreadable", "", "", '{"problem": "no valid request"}'
        return
    for tag, path, parent, node in visit(request):
        fields = json.dumps({f: _text(node.get(f)) for f in _FIELDS[tag] if node.get(f) is not None}, ensure_ascii=False) if with_fields else None
        yield key, tag, path, parent, fields


def emit_tagged(df: DataFrame, key: str = "request_id", body: str = "body", with_fields: bool = True) -> DataFrame:
    """One row per node of every body (``TAGGED``); ``with_fields=False`` leaves the fields null for those who need links only."""
    schema = pa.schema([("request_id", pa.int64()), *((n, pa.string()) for n in ("node_kind", "node_path", "parent_path", "fields"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.extend(_emit(k, b, with_fields))
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return df.select(F.col(key).cast("bigint"), F.col(body).cast("string")).mapInArrow(run, TAGGED)


def distinct_nodes(tagged: DataFrame, with_fields: bool = False) -> DataFrame:
    """Repeated deliveries count once."""
    return (tagged if with_fields else tagged.drop("fields")).distinct()


def write_tables(tagged: DataFrame, path: str) -> None:
    """Store all tables in one pass, partitioned by tag."""
    tagged.write.partitionBy("node_kind").mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One tag's table with its typed columns; a tag that never occurred gives an empty table."""
    if kind not in SCHEMAS:
        raise ValueError(f"unknown table {kind!r}; there are {', '.join(KINDS)}")
    rows = spark.read.schema(TAGGED).parquet(path).where(F.col("node_kind") == kind)
    return rows.select("request_id", "node_path", "parent_path", F.from_json("fields", SCHEMAS[kind]).alias("f")).select("request_id", "node_path", "parent_path", "f.*")


def links_of(spark: SparkSession, path: str, *kinds: str) -> DataFrame:
    """(request_id, node_kind, node_path, parent_path) of the tables of some tags; repeated deliveries count once."""
    link = lambda kind: read_table(spark, path, kind).select("request_id", F.lit(kind).alias("node_kind"), "node_path", "parent_path")
    return reduce(DataFrame.unionByName, map(link, kinds)).distinct()


def _payload(names: dict[str, Column], types: T.StructType) -> Column:
    """A node's fields as JSON, as ``_emit`` gives them: text and flags as they are, all else as text."""
    parts = []
    for f in types.fields:
        if f.name in names:
            c = names[f.name]
            plain = isinstance(f.dataType, (T.StringType, T.BooleanType))
            nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
            parts.append((c if plain else F.to_json(c) if nested else c.cast("string")).alias(f.name))
    return F.to_json(F.struct(*parts)) if parts else F.lit("{}")


def _node(kind: str, path: Column, parent: Column, fields: Column) -> Column:
    return F.struct(F.lit(kind).alias("node_kind"), path.alias("node_path"), parent.alias("parent_path"), fields.alias("fields"))


def emit_arrays(requests: DataFrame, with_fields: bool = True) -> DataFrame:
    """One row per node of every parsed request (``TAGGED``), as :func:`emit_tagged` for bodies; null entries keep their position.

    Each row is expanded once, into all of its nodes. Columns and struct fields
    named as in ``SCHEMAS`` are the payload, whichever of them are there. What
    tells one delivery from another (``received_at``) is no part of a request.
    """
    none, null = F.lit(""), F.lit(None).cast("string")
    of = lambda kind, value, types: _payload({n: value[n] for n in _FIELDS[kind]}, T.StructType([f for f in types.fields if f.name in _FIELDS[kind]])) if with_fields else null
    element, item = requests.schema["dom_elements"].dataType.elementType, requests.schema["redaction_manifest"].dataType.elementType
    rect = T.StructType([T.StructField("value", element["rect"].dataType)])

    def nodes_of_element(e: Column, at: Column) -> Column:
        path = at.cast("string")
        own = F.when(e.isNotNull(), _node("element", path, none, of("element", e, element)))
        return F.array(own, F.when(e["rect"].isNotNull(), _node("rect", F.concat(path, F.lit("/rect")), path, _payload({"value": e["rect"]}, rect) if with_fields else null)))

    request = _payload({n: F.col(n) for n in requests.columns}, T.StructType([f for f in requests.schema.fields if f.name in _FIELDS["request"]])) if with_fields else null
    nodes = F.concat(
        F.array(_node("request", none, none, request)),
        F.flatten(F.transform(F.coalesce(F.col("dom_elements"), F.array().cast(requests.schema["dom_elements"].dataType)), nodes_of_element)),
        F.transform(F.coalesce(F.col("redaction_manifest"), F.array().cast(requests.schema["redaction_manifest"].dataType)), lambda e, at: F.when(e.isNotNull(), _node("redaction", at.cast("string"), none, of("redaction", e, item)))),
    )
    rows = requests.select(F.col("request_id").cast("bigint").alias("request_id"), F.explode(nodes).alias("n")).where("n IS NOT NULL")
    return rows.select("request_id", "n.*")


def flatten_arrays(requests: DataFrame) -> DataFrame:
    """The arrays of parsed requests as links of the same shape (no ``fields``); null entries keep their position."""
    return emit_arrays(requests, with_fields=False).where("node_kind <> 'request'").drop("fields")
