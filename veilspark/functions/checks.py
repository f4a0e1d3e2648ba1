"""Check digits, in plain Python and as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the Verhoeff scheme: the multiplication of the dihedral group D5 and the permutation by position.
_D = ("0123456789", "1234067895", "2340178956", "3401289567", "4012395678", "5987604321", "6598710432", "7659821043", "8765932104", "9876543210")
_P = ("0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258")
_STEP = [[[int(_D[c][int(_P[i][d])]) for d in range(10)] for c in range(10)] for i in range(8)]


def verhoeff_ok(digits: str) -> bool:
    """Whether the last digit checks all before it."""
    c = 0
    for i, d in enumerate(reversed(digits)):
        c = _STEP[i % 8][c][ord(d) - 48]
    return c == 0


def verhoeff_sql(digits: str, length: int = 12) -> str:
    """SQL test of ``digits``, an expression of exactly ``length`` digits."""
    permuted = f"CAST(substr('{''.join(_P)}', (i % 8) * 10 + CAST(substr({digits}, {length} - i, 1) AS INT) + 1, 1) AS INT)"
    return f"aggregate(sequence(0, {length - 1}), 0, (c, i) -> CAST(substr('{''.join(_D)}', c * 10 + {permuted} + 1, 1) AS INT)) = 0"


def verhoeff_valid(digits: Column, length: int = 12) -> Column:
    """Whether a column of digits has ``length`` digits and a valid Verhoeff check digit."""
    checked = F.call_function("transform", F.array(digits), F.expr(f"x -> IF(x RLIKE '^[0-9]{{{length}}}$', {verhoeff_sql('x', length)}, false)"))
    return F.coalesce(F.get(checked, F.lit(0)), F.lit(False))


def luhn_valid(digits: Column, least: int = 13, most: int = 19) -> Column:
    """Whether a column of digits is of a card's length and passes the Luhn test."""
    return F.coalesce(F.length(digits).between(least, most) & F.call_function("luhn_check", digits), F.lit(False))
