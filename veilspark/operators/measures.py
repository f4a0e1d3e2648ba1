"""Rects, boxes and viewports recorded in different units, in CSS pixels.

Units come from three places, nearest first: the value itself (its text, or a
``unit`` beside it), the request (a note, or ``units`` in a body), the client.
Wordings are parsed by the grammar of :mod:`veilspark.functions.units` into
scale, offset and dimension exponents. For parsed requests only the short
notes pass through Python (Arrow batches, memoised); the arithmetic over the
arrays stays in Catalyst. Unparsed bodies are converted while they are walked.

Defined results: a missing pixel ratio is 1, a missing root font 16 px; values
without any unit in force, shares of an unknown viewport, null, non-finite or
unreadable numbers and boxes of other than four numbers give no row; empty
tables give empty results; repeated rows give the same rows again, which
:func:`matching_boxes` counts once. A viewport (``viewports=True``) is a row of
path ``''`` without left and top; if one of its sides is unknown that one is
null, if both are there is no row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.units import DIMENSIONS, Context, Unit, parse_quantity, parse_unit, stated_units, to_length
from ..session import materialise
from .nested import decode, parse_body, visit

FIELDS = ("rect", "box", "viewport")
SIDES = ("left", "top", "width", "height")
PLACED = "request_id BIGINT, kind STRING, path STRING, left DOUBLE, top DOUBLE, width DOUBLE, height DOUBLE"
_UNIT = T.StructType([T.StructField(n, T.DoubleType() if n in ("scale", "offset") else T.IntegerType()) for n in ("scale", "offset", "device", "rootfont", "axis")])


def _plain_length(u: Unit | None) -> tuple | None:
    if u is None or sum(u.dims[:4]) != 1 or any(u.dims[4:]) or min(u.dims) < 0:
        return None
    d = dict(zip(DIMENSIONS, u.dims))
    return u.scale, u.offset, d["device"], d["rootfont"], d["axis"]


@F.pandas_udf(T.StructType([T.StructField(f, _UNIT) for f in FIELDS]))
def units_in_force(note: pd.Series, rect: pd.Series, box: pd.Series, viewport: pd.Series) -> pd.DataFrame:
    """Units by field: what the note states, else what the client uses."""
    out: dict[str, list] = {f: [] for f in FIELDS}
    names = ("scale", "offset", "device", "rootfont", "axis")
    for n, *client in zip(note, rect, box, viewport):
        said = dict(stated_units(n))
        for f, c in zip(FIELDS, client):
            u = _plain_length(parse_unit(said.get(f, c)))
            out[f].append(None if u is None else dict(zip(names, u)))
    return pd.DataFrame(out)


def _css(value: Column, unit: Column, ratio: Column, root: Column, axis: Column) -> Column:
    value = value.cast("double") * unit["scale"] + unit["offset"]
    return F.when(unit["device"] == 1, value / ratio).when(unit["rootfont"] == 1, value * root).when(unit["axis"] == 1, value * axis).otherwise(value)


def _first_key(m: Column, *names: str) -> Column:
    return F.coalesce(*(F.try_element_at(m, F.lit(n)) for n in names))


def request_contexts(requests: DataFrame, clients: DataFrame) -> DataFrame:
    """``requests`` with ``units`` in force and ``view`` (CSS px width and height, ratio, root)."""
    c = clients.select(F.col("client").alias("_client"), *(F.col(f"{f}_unit").alias(f"_{f}") for f in FIELDS)).dropDuplicates(["_client"])
    v = F.col("viewport")
    ratio, root = _first_key(v, "dpr", "devicePixelRatio"), _first_key(v, "rootFontSize")
    joined = requests.join(c, F.col("client") == F.col("_client"), "left").withColumn("units", units_in_force(F.col("capture_note"), *(F.col(f"_{f}") for f in FIELDS)))
    ratio, root = F.when(ratio > 0, ratio).otherwise(1.0), F.when(root > 0, root).otherwise(16.0)
    side = lambda *names: _css(_first_key(v, *names), F.col("units.viewport"), ratio, root, F.lit(None).cast("double"))
    return joined.withColumn("view", F.struct(side("width", "innerWidth", "w").alias("width"), side("height", "innerHeight", "h").alias("height"), ratio.alias("ratio"), root.alias("root"))).drop("_client", *(f"_{f}" for f in FIELDS))


def _finite(side: Column) -> Column:
    return F.when(~F.isnan(side) & (F.abs(side) != float("inf")), side)


def place_requests(requests: DataFrame, clients: DataFrame, viewports: bool = False) -> DataFrame:
    """All rects and boxes of parsed requests in CSS px (``PLACED``), with ``viewports`` those too: each request is read and expanded once."""
    narrow = requests.select("request_id", "client", "capture_note", "viewport", F.col("dom_elements.rect").alias("rects"), F.col("redaction_manifest.box").alias("boxes"))  # reads these leaves only
    base = request_contexts(narrow, clients)
    types = dict(narrow.dtypes)

    ratio, root, axes = F.col("view.ratio"), F.col("view.root"), [F.col("view.width"), F.col("view.height")] * 2

    def item(kind: str, at: Column, sides: list[Column]) -> Column:
        return F.struct(F.lit(kind).alias("kind"), at.cast("string").alias("path"), *(_finite(s.cast("double")).alias(n) for s, n in zip(sides, SIDES)))

    css = lambda kind, raw: [_css(r, F.col(f"units.{kind}"), ratio, root, axis) for r, axis in zip(raw, axes)]
    rect = lambda r, at: F.when(r.isNotNull(), item("rect", at, css("rect", [r[n] for n in SIDES])))
    box = lambda b, at: F.when(F.size(b) == 4, item("box", at, css("box", [F.get(b, F.lit(i)) for i in range(4)])))
    items = [F.transform(F.coalesce(c, F.array().cast(types[c])), f) for c, f in (("rects", rect), ("boxes", box))]
    if viewports:
        items.append(F.array(item("viewport", F.lit(""), [F.lit(None), F.lit(None), *axes[:2]])))
    rows = base.select("request_id", F.explode(F.concat(*items)).alias("n")).select("request_id", "n.*")
    known = "left IS NOT NULL AND top IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL"
    return rows.where(f"kind IS NOT NULL AND IF(kind = 'viewport', width IS NOT NULL OR height IS NOT NULL, {known})")


# ------------------------------------------------------------------ unparsed bodies

_DECLARATION = re.compile(r"\s*(left|top|width|height|x|y|w|h)\s*:\s*([^;]+?)\s*(?:;|$)", re.I)
_SIZE = re.compile(r"\s*(?P<w>[\d.]+\s*[^\d@]*?)\s*[x×,]\s*(?P<h>[\d.]+\s*[^\d@]*?)\s*(?:@\s*(?P<ratio>[\d.]+)\s*x?)?\s*", re.I)
_NAMES = (("left", "x"), ("top", "y"), ("width", "w"), ("height", "h"))


def _sides(value: Any) -> tuple[list, Any] | None:
    """Four raw values and the unit beside them."""
    value = decode(value)
    if isinstance(value, str):
        value = {k.lower(): v for k, v in _DECLARATION.findall(value)}
    if isinstance(value, list):
        return (value, None) if len(value) == 4 else None
    if isinstance(value, dict):
        four = [next((value[n] for n in names if n in value), None) for names in _NAMES]
        return (four, value.get("unit")) if any(v is not None for v in four) else None
    return None


def _resolve(raw: Any, beside: Unit | None, in_force: Unit | None, context: Context, horizontal: bool) -> float | None:
    q = parse_quantity(raw)
    if q is None:
        return None
    return to_length(q[0], q[1] or beside or in_force, context, horizontal)


def body_context(request: dict, in_force: dict[str, Unit | None]) -> Context:
    """The viewport of a body in CSS px with its ratio and root font."""
    v = decode(request.get("viewport"))
    w = h = ratio = root = beside = None
    if isinstance(v, str) and (m := _SIZE.fullmatch(v)):
        w, h, ratio = m["w"], m["h"], m["ratio"]
    elif isinstance(v, list) and len(v) >= 2:
        w, h = v[:2]
    elif isinstance(v, dict):
        size = decode(v.get("size"))
        if isinstance(size, str) and (m := _SIZE.fullmatch(size)):
            size = [m["w"], m["h"]]
        if isinstance(size, list) and len(size) >= 2:
            w, h = size[:2]
        first = lambda *names: next((v[n] for n in names if v.get(n) is not None), None)
        w, h = (first("width", "innerWidth", "w") if w is None else w), (first("height", "innerHeight", "h") if h is None else h)
        ratio, root, beside = first("dpr", "devicePixelRatio"), first("rootFontSize"), parse_unit(v.get("unit") if isinstance(v.get("unit"), str) else None)
    number = lambda x, default: q[0] if (q := parse_quantity(x)) and q[0] > 0 else default
    plain = Context(None, None, number(ratio, 1.0), number(root, 16.0))
    return Context(*(_resolve(x, beside, in_force["viewport"], plain, i == 0) for i, x in enumerate((w, h))), plain.ratio, plain.root)


def place_body(body: str | None, client_units: dict[str, str | None], viewports: bool = False) -> Iterator[tuple[str, str, float | None, float | None, float | None, float | None]]:
    """(kind, path, left, top, width, height) of every rect and box of one body, with ``viewports`` of its viewport too."""
    request = parse_body(body)
    if request is None:
        return
    said = decode(request.get("units"))
    said = dict(stated_units(said)) if isinstance(said, str) else said if isinstance(said, dict) else {}
    in_force = {f: parse_unit(u) if isinstance(u := said.get(f), str) and parse_unit(u) else parse_unit(client_units.get(f)) for f in FIELDS}
    context = body_context(request, in_force)
    if viewports:
        size = [v if v is not None and math.isfinite(v) else None for v in (context.width, context.height)]
        if size != [None, None]:
            yield "viewport", "", None, None, *size
    for tag, path, _, node in visit(request):
        if tag == "rect":
            kind, value, owner, path = "rect", node["value"], node["element"], path.removesuffix("/rect")
        elif tag == "redaction":
            kind, value, owner = "box", node.get("box"), node
        else:
            continue
        found = _sides(value)
        if not found:
            continue
        raw, unit = found
        unit = unit if isinstance(unit, str) else owner.get("unit")
        beside = parse_unit(unit) if isinstance(unit, str) else None
        sides = [_resolve(r, beside, in_force[kind], context, i % 2 == 0) for i, r in enumerate(raw)]
        if all(s is not None for s in sides):
            yield kind, path, *sides


def place_bodies(payloads: DataFrame, clients: DataFrame, body: str = "body", viewports: bool = False) -> DataFrame:
    """All rects and boxes of unparsed bodies in CSS px (``PLACED``), with ``viewports`` those too."""
    c = clients.select(F.col("client").alias("_client"), *(F.col(f"{f}_unit").alias(f"_{f}") for f in FIELDS)).dropDuplicates(["_client"])
    joined = payloads.select(F.col("request_id").cast("bigint"), "client", F.col(body).alias("_body")).join(c, F.col("client") == F.col("_client"), "left").select("request_id", "_body", *(f"_{f}" for f in FIELDS))
    schema = pa.schema([("request_id", pa.int64()), ("kind", pa.string()), ("path", pa.string()), *((n, pa.float64()) for n in ("left", "top", "width", "height"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, *r) for key, text, *units in zip(*(c.to_pylist() for c in batch.columns)) for r in place_body(text, dict(zip(FIELDS, units)), viewports)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return joined.mapInArrow(run, PLACED)


def matching_boxes(placed: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Pairs of a box and a rect of one request that differ by at most ``tolerance`` in every side.

    A band join on a grid: a rect lies in one cell of its request's space of
    left, top, width and height, a box looks into the few cells its tolerance
    reaches, and the join is on request and cell. However many items one request
    holds, and however many of them begin at one point, only those alike in place
    and size meet, and its cells spread over the partitions. Both sides come from
    one written table, so ``placed`` is computed once.
    """
    cell, slack = 16 * tolerance, tolerance + 1e-6
    at = lambda c: F.floor(c / cell)
    reach = lambda n: F.when(F.col("kind") == "rect", F.array(at(F.col(n)))).otherwise(F.array_distinct(F.array(at(F.col(n) - slack), at(F.col(n) + slack))))
    cells = placed.where(F.col("kind").isin("rect", "box")).select("*", *(reach(n).alias(f"c_{n}") for n in SIDES))
    for n in SIDES:
        cells = cells.withColumn(f"c_{n}", F.explode(f"c_{n}"))
    cells = materialise(cells, "placed")
    keys = ["request_id", *(f"c_{n}" for n in SIDES)]
    rects = cells.where("kind = 'rect'").select(*keys, F.col("path").alias("element_path"), *(F.col(n).alias(f"r_{n}") for n in SIDES))
    boxes = cells.where("kind = 'box'").select(*keys, F.col("path").alias("item_path"), *SIDES)
    near = [F.abs(F.col(n) - F.col(f"r_{n}")) <= slack for n in SIDES]
    return boxes.join(rects, keys).where(near[0] & near[1] & near[2] & near[3]).select("request_id", "item_path", "element_path").distinct()
