"""What columns cannot express: redaction of JSON of any depth, and a table function for SQL."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checks import verhoeff_ok
from .patterns import PATTERNS

_COMPILED = [(p, re.compile(p.regex, re.ASCII | (re.I if p.ignore_case else 0))) for p in PATTERNS]


def _luhn(d: str) -> bool:
    total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
    return 13 <= len(d) <= 19 and total % 10 == 0


_TESTS = {
    None: lambda m: True,
    "luhn": lambda m: _luhn(re.sub("[ -]", "", m)),
    "verhoeff": lambda m: verhoeff_ok(re.sub("[ -]", "", m)),
    "octets": lambda m: all(int(o) <= 255 for o in m.split(".")),
}


def scan(text: str) -> list[tuple[int, int, str, str, float]]:
    """(idx, pattern order, kind, match, confidence) in order, as :func:`veilspark.functions.text.scan_text` gives them."""
    hits = []
    for i, (p, regex) in enumerate(_COMPILED):
        for m in regex.finditer(text):
            alone = not p.guard or not (re.search(r"[0-9][ -]?$", text[max(0, m.start() - 2) : m.start()]) or re.match(r"[ -]?[0-9]", text[m.end() : m.end() + 2]))
            if alone and _TESTS[p.check](m[0]):
                hits.append((m.start(), i, p.id, m[0], p.confidence))
    return sorted(hits)


def scrub(text: str) -> tuple[str, list[str]]:
    """Text with placeholders, overlapping hits joined, and the kinds replaced."""
    spans: list[list] = []
    for idx, _, kind, match, _ in scan(text):
        if spans and idx < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], idx + len(match))
        else:
            spans.append([idx, idx + len(match), kind])
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[REDACTED:{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:], [k for _, _, k in spans]


def scrub_value(node: Any, counts: dict[str, int]) -> Any:
    """A JSON value with every string scrubbed; ``value`` of an object marked ``__sensitive`` is blanked. Works without recursion."""
    root = [node]
    stack: list[tuple[Any, Any]] = [(root, 0)]
    while stack:
        holder, key = stack.pop()
        v = holder[key]
        if isinstance(v, str):
            holder[key], kinds = scrub(v)
            for k in kinds:
                counts[k] = counts.get(k, 0) + 1
        elif isinstance(v, dict):
            v = holder[key] = dict(v)
            for k in v:
                if k == "value" and v.get("__sensitive") is True:
                    v[k] = "[REDACTED:FIELD]"
                    counts["field"] = counts.get("field", 0) + 1
                else:
                    stack.append((v, k))
        elif isinstance(v, list):
            v = holder[key] = list(v)
            stack.extend((v, i) for i in range(len(v)))
    return root[0]


@F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("by_kind", T.MapType(T.StringType(), T.IntegerType()))]))
def scrub_json(body: pd.Series) -> pd.DataFrame:
    """JSON text of any depth, scrubbed, with counts by kind. Null and unreadable text gives null: nothing unscrubbed leaves."""
    out: dict[str, list] = {"json": [], "by_kind": []}
    for b in body:
        counts: dict[str, int] = {}
        try:
            clean = json.dumps(scrub_value(json.loads(b), counts), ensure_ascii=False)
        except (TypeError, ValueError, RecursionError):
            clean, counts = None, {}
        out["json"].append(clean)
        out["by_kind"].append(counts)
    return pd.DataFrame(out)


class _ScanRows:
    def eval(self, text: str | None) -> Iterator[tuple[str, str, int, float]]:
        for idx, _, kind, match, confidence in scan(text) if text else ():
            yield kind, match, idx, confidence


def register_sql(spark: SparkSession) -> None:
    """SQL names: ``scan_text_rows(text)`` for LATERAL use, ``scrub_json(text)`` and ``scrub_text(text)``."""
    spark.udtf.register("scan_text_rows", F.udtf(_ScanRows, returnType="kind STRING, match STRING, idx INT, confidence DOUBLE"))
    spark.udf.register("scrub_json", scrub_json)
    spark.udf.register("scrub_text", F.pandas_udf(lambda s: s.map(lambda t: scrub(t)[0] if t else t), T.StringType()))
