"""Scanning text for identifiers and replacing them, as Catalyst expressions.

A pattern's matches and the pieces between them come from two built-in regex
functions; offsets are running sums of their lengths, which gives leftmost,
non-overlapping matches: one that fails its check is dropped but stays
consumed. A cheap test guards every pattern, so texts without a digit, ``@`` or
``+`` never meet the expensive ones. Offsets count code points.

The expressions are written as SQL lambdas and applied to a column with a
handful of calls: the same tree built node by node from Python takes seconds.

Defined results: null text gives null hits and stays null; text without hits
gives an empty array and comes back unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checks import verhoeff_sql
from .patterns import PATTERNS, Pattern, jvm_regex

HIT = "STRUCT<idx: INT, ord: INT, id: STRING, match: STRING, confidence: DOUBLE>"
SPAN = "STRUCT<start: INT, stop: INT, id: STRING, confidence: DOUBLE>"
_NONE = f"CAST(array() AS ARRAY<{HIT}>)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literals(words: Sequence[str]) -> Column:
    """An array of constant words."""
    return F.expr("array(" + ", ".join(f"'{w}'" for w in words) + ")")


def apply_sql(function: str, value: Column) -> Column:
    """A SQL lambda (``x -> ...``) applied to a column."""
    return F.get(F.call_function("transform", F.array(value), F.expr(function)), F.lit(0))


def strip_separators(c: Column) -> Column:
    return F.translate(c, " -", "")


_NEEDS = {"digit": "t RLIKE '[0-9]'", "@": "contains(t, '@')", "+": "contains(t, '+')"}
_CLEAN = "translate(h.match, ' -', '')"
_CHECKS = {
    "luhn": f"(length({_CLEAN}) BETWEEN 13 AND 19 AND luhn_check({_CLEAN}))",
    "verhoeff": f"({verhoeff_sql(_CLEAN)})",
    "octets": "forall(split(h.match, '[.]'), o -> CAST(o AS INT) <= 255)",
}
# no digit continues the match to its left or right, separator or not
_GUARD = "(NOT substr(t, greatest(h.idx - 1, 1), least(h.idx, 2)) RLIKE '[0-9][ -]?$' AND NOT substr(t, h.idx + length(h.match) + 1, 2) RLIKE '^[ -]?[0-9]')"


def _hits_sql(ordinal: int, p: Pattern) -> str:
    regex = jvm_regex(p.regex, p.ignore_case)
    place = f"named_struct('idx', a.at + length(get(f.s, i)), 'ord', {ordinal}, 'id', '{p.id}', 'match', get(f.m, i), 'confidence', {p.confidence}D)"
    step = f"(a, i) -> named_struct('at', a.at + length(get(f.s, i)) + length(get(f.m, i)), 'out', concat(a.out, array({place})))"
    placed = f"IF(size(f.m) > 0, aggregate(sequence(0, size(f.m) - 1), named_struct('at', 0, 'out', {_NONE}), {step}, a -> a.out), {_NONE})"
    hits = f"get(transform(array(named_struct('m', regexp_extract_all(t, r'{regex}', 0), 's', split(t, r'{regex}', -1))), f -> {placed}), 0)"
    tests = [*([_CHECKS[p.check]] if p.check else []), *([_GUARD] if p.guard else [])]
    if tests:
        hits = f"filter({hits}, h -> {' AND '.join(tests)})"
    return f"IF({_NEEDS[p.needs]}, {hits}, {_NONE})"


@lru_cache(maxsize=64)
def _scan_sql(kinds: tuple[str, ...] | None) -> str:
    arrays = [_hits_sql(i, p) for i, p in enumerate(PATTERNS) if kinds is None or p.id in kinds]
    # most texts fail all cheap tests, and one of them ends the matter
    return f"t -> IF(t IS NULL, NULL, IF(t RLIKE '[0-9@+]', array_sort(concat({', '.join(arrays)})), {_NONE}))"


def scan_text(text: Column, kinds: Sequence[str] | None = None) -> Column:
    """All hits of a text, by place and then by pattern order; hits of different kinds may overlap."""
    return apply_sql(_scan_sql(None if kinds is None else tuple(kinds)), text)


_MERGE = f"""x -> aggregate(x, CAST(array() AS ARRAY<{SPAN}>), (m, h) -> CASE
  WHEN size(m) = 0 THEN array(named_struct('start', h.idx, 'stop', h.idx + length(h.match), 'id', h.id, 'confidence', h.confidence))
  WHEN h.idx < element_at(m, -1).stop THEN concat(slice(m, 1, size(m) - 1), array(named_struct('start', element_at(m, -1).start, 'stop', greatest(element_at(m, -1).stop, h.idx + length(h.match)), 'id', element_at(m, -1).id, 'confidence', element_at(m, -1).confidence)))
  ELSE concat(m, array(named_struct('start', h.idx, 'stop', h.idx + length(h.match), 'id', h.id, 'confidence', h.confidence))) END)"""


def merged_spans(hits: Column) -> Column:
    """Hits with overlapping ones joined into one span that keeps the first one's kind."""
    return apply_sql(_MERGE, hits)


_REBUILD = "aggregate(y.s, named_struct('at', 0, 'out', ''), (b, p) -> named_struct('at', p.stop, 'out', concat(b.out, substr(y.t, b.at + 1, p.start - b.at), '[REDACTED:', upper(p.id), ']')), b -> concat(b.out, substr(y.t, b.at + 1)))"
_SCRUB = f"""y -> named_struct('text', IF(size(y.s) > 0, {_REBUILD}, y.t),
  'redactions', transform(y.s, p -> named_struct('kind', p.id, 'confidence', p.confidence, 'length', p.stop - p.start)))"""


def _scrub_once(text: Column, kinds: Sequence[str] | None) -> Column:
    """(text, redactions): the text with placeholders, and kind, confidence and length of what they replace."""
    return apply_sql(_SCRUB, F.struct(text.alias("t"), merged_spans(scan_text(text, kinds)).alias("s")))


def scrub_text(text: Column, kinds: Sequence[str] | None = None, passes: int = 1) -> Column:
    """``passes`` scans: what a first redaction uncovers (a run that was too long before) goes with the second."""
    out = _scrub_once(text, kinds)
    for _ in range(passes - 1):
        out = let(out, lambda a: let(_scrub_once(a["text"], kinds), lambda b: F.struct(b["text"].alias("text"), F.concat(a["redactions"], b["redactions"]).alias("redactions"))))
    return F.when(text.isNotNull(), out)


def redact_fields(element: Column, fields: Sequence[str], sensitive: Column, value_field: str = "value") -> Column:
    """A struct with its text fields scrubbed; a sensitive element's value is blanked whatever it holds."""
    for f in fields:
        clean = scrub_text(element[f])["text"]
        element = element.withField(f, F.when(sensitive & element[f].isNotNull(), F.lit("[REDACTED:FIELD]")).otherwise(clean) if f == value_field else clean)
    return element
