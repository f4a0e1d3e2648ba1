"""SQL texts of the scanner and the geometry for engines whose regexes have ASCII ``\\b`` and no lookbehind."""

from __future__ import annotations

from ..functions.checks import _D, _P
from ..functions.patterns import PATTERNS, Pattern


def verhoeff_sql(digits: str) -> str:
    d, p = "".join(_D), "".join(_P)
    return f"list_reduce(range(0, 12), lambda c, i: CAST(substr('{d}', CAST(c * 10 + CAST(substr('{p}', CAST((i % 8) * 10 + CAST(substr({digits}, CAST(12 - i AS INT), 1) AS INT) + 1 AS INT), 1) AS INT) + 1 AS INT), 1) AS BIGINT), 0) = 0"


def luhn_sql(digits: str) -> str:
    digit = f"CAST(substr({digits}, CAST(length({digits}) - i AS INT), 1) AS INT)"
    return f"(length({digits}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length({digits})), lambda i: CASE WHEN i % 2 = 1 THEN ({digit} * 2) // 10 + ({digit} * 2) % 10 ELSE {digit} END)) % 10 = 0)"


def _hits(p: Pattern, ordinal: int, key: str, source: str) -> str:
    option = "'i'" if p.ignore_case else "'c'"
    clean = "replace(replace(match, ' ', ''), '-', '')"
    test = {None: "true", "luhn": luhn_sql("clean"), "verhoeff": f"(CASE WHEN length(clean) = 12 THEN {verhoeff_sql('clean')} ELSE false END)", "octets": "len(list_filter(string_split(match, '.'), lambda o: CAST(o AS INT) > 255)) = 0"}[p.check]
    guard = "AND NOT regexp_matches(substr(text, greatest(idx - 1, 1), least(idx, 2)), '[0-9][ -]?$') AND NOT regexp_matches(substr(text, idx + length(match) + 1, 2), '^[ -]?[0-9]')" if p.guard else ""
    regex = p.regex.replace("'", "''")
    return f"""SELECT {key}, idx, {ordinal} AS ord, '{p.id}' AS id, match, CAST({p.confidence} AS DOUBLE) AS confidence FROM (
  SELECT *, {clean} AS clean FROM (
    SELECT {key}, text, m[i] AS match, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INT) AS idx
    FROM (SELECT {key}, text, m, s, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key}, text, regexp_extract_all(text, '{regex}', 0, {option}) AS m, string_split_regex(text, '{regex}'{", 'i'" if p.ignore_case else ''}) AS s FROM {source} WHERE text IS NOT NULL))))
WHERE {test} {guard}"""


def hits_sql(key: str, source: str) -> str:
    """(key..., idx, ord, id, match, confidence) of every hit in ``source(key..., text)``."""
    return "\nUNION ALL ".join(_hits(p, i, key, source) for i, p in enumerate(PATTERNS))


def scrubbed_sql(key: str, source: str) -> str:
    """(key, text, n) after one scrub, overlapping hits joined."""
    return f"""WITH h AS ({hits_sql(key, source)}),
a AS (SELECT *, idx + length(match) AS stop, max(idx + length(match)) OVER (PARTITION BY {key} ORDER BY idx, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
b AS (SELECT *, sum(CASE WHEN before IS NULL OR idx >= before THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY idx, ord) AS span FROM a),
c AS (SELECT {key}, span, min(idx) AS start, max(stop) AS stop, arg_min(id, idx * 100 + ord) AS kind FROM b GROUP BY {key}, span),
d AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY {key} ORDER BY start), 0) AS since FROM c),
e AS (SELECT d.{key}, string_agg(substr(t.text, since + 1, start - since) || '[REDACTED:' || upper(kind) || ']', '' ORDER BY start) || substr(any_value(t.text), max(stop) + 1) AS text, CAST(count(*) AS BIGINT) AS n FROM d JOIN {source} t ON t.{key} = d.{key} GROUP BY d.{key})"""
