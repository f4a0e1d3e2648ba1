"""Units of measure: a grammar for numbers and unit expressions, exponent vectors and affine conversion.

``parse_unit`` and ``parse_quantity`` read free wording ("hundredths of an
inch", "0.01 % of viewport", "12.5 cm", "degrees F per minute") by recursive
descent into a :class:`Unit`: a scale and an offset to the canonical unit, and
a vector of exponents over the base dimensions. Base dimensions that only a
context can resolve (device pixels, the root font, shares of the viewport) are
kept as dimensions of their own, so the same parsed unit serves every request;
:func:`to_length` applies the context.

Defined results: null, empty or unreadable wording gives ``None``; a number
without a unit gives a quantity whose unit is ``None``; a unit that is no
length gives ``None`` from :func:`to_length`.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

#: Base dimensions, in the order of a unit's exponent vector.
DIMENSIONS = ("length", "device", "rootfont", "axis", "time", "mass", "temperature")
_ZERO = (0,) * len(DIMENSIONS)


@dataclass(frozen=True)
class Unit:
    """``canonical = value * scale + offset`` in the canonical units of ``dims`` (CSS px, device px, ..., s, kg, K)."""

    scale: float
    dims: tuple[int, ...]
    offset: float = 0.0

    def __mul__(self, other: Unit) -> Unit:
        dims = tuple(a + b for a, b in zip(self.dims, other.dims))
        plain = not any(self.dims) or not any(other.dims)  # an offset has no meaning within a compound unit
        return Unit(self.scale * other.scale, dims, self.offset + other.offset if plain else 0.0)

    def power(self, n: int) -> Unit:
        return self if n == 1 else Unit(self.scale**n, tuple(a * n for a in self.dims))


def _base(dim: str, scale: float = 1.0, offset: float = 0.0) -> Unit:
    return Unit(scale, tuple(int(d == dim) for d in DIMENSIONS), offset)


_NUMBER = Unit(1.0, _ZERO)
_IN = 96.0
#: Words of a unit name (longest match first) and what they mean.
_ATOMS: dict[tuple[str, ...], Unit] = {
    **{tuple(n.split()): _base("length") for n in ("px", "pixel", "pixels", "css px", "css pixel", "css pixels", "px css", "pixels css")},
    **{tuple(n.split()): _base("device") for n in ("device px", "device pixel", "device pixels", "physical px", "physical pixel", "physical pixels", "hardware pixels")},
    **{tuple(n.split()): _base("rootfont") for n in ("rem", "rems", "root em", "root ems")},
    **{tuple(n.split()): _base("axis") for n in ("viewport", "window", "viewport size", "axis")},
    **{(n,): _base("length", _IN) for n in ("in", "inch", "inches")},
    **{(n,): _base("length", _IN * 12) for n in ("ft", "foot", "feet")},
    **{(n,): _base("length", _IN / 72) for n in ("pt", "point", "points")},
    **{(n,): _base("length", _IN / 6) for n in ("pc", "pica", "picas")},
    **{(n,): _base("length", _IN / 1440) for n in ("twip", "twips")},
    **{(n,): _base("length", _IN / 25.4) for n in ("mm", "millimetre", "millimetres", "millimeter", "millimeters")},
    **{(n,): _base("length", _IN / 2.54) for n in ("cm", "centimetre", "centimetres", "centimeter", "centimeters")},
    **{(n,): _base("length", _IN / 0.0254) for n in ("m", "metre", "metres", "meter", "meters")},
    **{(n,): _base("length", _IN / 0.0000254) for n in ("km", "kilometre", "kilometres", "kilometer", "kilometers")},
    **{(n,): _base("time") for n in ("s", "sec", "second", "seconds")},
    **{(n,): _base("time", 1e-3) for n in ("ms", "millisecond", "milliseconds")},
    **{(n,): _base("time", 60) for n in ("min", "minute", "minutes")},
    **{(n,): _base("time", 3600) for n in ("h", "hour", "hours")},
    **{(n,): _base("mass") for n in ("kg", "kilogram", "kilograms")},
    **{(n,): _base("mass", 1e-3) for n in ("g", "gram", "grams")},
    **{tuple(n.split()): _base("temperature") for n in ("k", "kelvin")},
    **{tuple(n.split()): _base("temperature", 1.0, 273.15) for n in ("°c", "degrees c", "celsius")},
    **{tuple(n.split()): _base("temperature", 5 / 9, 273.15 - 32 * 5 / 9) for n in ("°f", "degrees f", "fahrenheit")},
    **{(n,): Unit(0.01, _ZERO) for n in ("%", "percent")},
    **{(n,): _NUMBER for n in ("fraction", "share", "proportion")},
    **{(n,): Unit(0.1, _ZERO) for n in ("tenth", "tenths")},
    **{(n,): Unit(0.01, _ZERO) for n in ("hundredth", "hundredths")},
    **{(n,): Unit(1e-3, _ZERO) for n in ("thousandth", "thousandths")},
}
_LONGEST = max(map(len, _ATOMS))
_SKIP = {"of", "the", "a", "an", "*", "·", "(", ")"}
_TOKEN = re.compile(r"\s*(?:(\d+\.\.\d+)|(\d+(?:\.\d+)?(?:e[+-]?\d+)?|\.\d+)|(°[a-z]|[a-z]+|%)|(\*\*|[\^/*·()+-]))")
_VALUE = re.compile(r"\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)\s*(.*?)\s*", re.S)


class _Parser:
    """expr := factor (("/" | "per") factor | factor)* ; factor := ratio | atom ("^" integer)?"""

    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.strip().lower()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(text)
            at = m.end()
            if m[1] is None:  # a range such as 0..1 only explains a fraction
                self.tokens.append(("n", m[2]) if m[2] else ("w", m[3]) if m[3] else ("o", m[4]))
        self.at = 0

    def peek(self) -> tuple[str, str] | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def expr(self) -> Unit:
        unit, seen = _NUMBER, False
        while (t := self.peek()) is not None:
            if t[1] in _SKIP:
                self.take()
            elif t[1] in ("/", "per"):
                self.take()
                unit = unit * self.factor().power(-1)
            else:
                unit, seen = unit * self.factor(), True
        if not seen:
            raise ValueError("no unit")
        return unit

    def factor(self) -> Unit:
        while (t := self.peek()) is not None and t[1] in _SKIP:
            self.take()
        if t is None:
            raise ValueError("incomplete")
        if t[0] == "n":
            return Unit(float(self.take()[1]), _ZERO)
        for n in range(min(_LONGEST, len(self.tokens) - self.at), 0, -1):
            words, at = [], self.at  # "px (css)" reads as "px css"
            while len(words) < n and at < len(self.tokens):
                if self.tokens[at][1] not in ("(", ")"):
                    words.append(self.tokens[at][1])
                at += 1
            if tuple(words) in _ATOMS:
                self.at = at
                unit = _ATOMS[tuple(words)]
                if (p := self.peek()) is not None and p[1] in ("^", "**"):
                    self.take()
                    sign = -1 if (q := self.peek()) is not None and q[1] == "-" else 1
                    self.at += sign < 0
                    unit = unit.power(sign * int(self.take()[1]))
                return unit
        raise ValueError(t[1])


@lru_cache(maxsize=65536)
def parse_unit(text: str | None) -> Unit | None:
    """The unit a wording stands for, or ``None``."""
    if text is None or not text.strip():
        return None
    try:
        return _Parser(text).expr()
    except (ValueError, IndexError):
        return None


def parse_quantity(value: object) -> tuple[float, Unit | None] | None:
    """A number, or a text holding one with or without its unit. Non-finite and boolean values are none."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return (float(value), None) if math.isfinite(value) else None
    if not isinstance(value, str) or not (m := _VALUE.fullmatch(value)):
        return None
    number = float(m[1])
    if not math.isfinite(number):
        return None
    if not m[2]:
        return number, None
    unit = parse_unit(m[2])
    return None if unit is None else (number, unit)


@dataclass(frozen=True)
class Context:
    """What a request says about its display: CSS px of the viewport (``None`` if unknown), pixel ratio, root font size."""

    width: float | None = None
    height: float | None = None
    ratio: float = 1.0
    root: float = 16.0


def to_length(number: float, unit: Unit | None, context: Context, horizontal: bool) -> float | None:
    """CSS px of a quantity; ``None`` if the unit is no length or the context lacks what it refers to."""
    if unit is None or sum(unit.dims[:4]) != 1 or any(unit.dims[4:]) or any(d < 0 for d in unit.dims):
        return None
    _, device, root, axis, *_ = unit.dims
    value = number * unit.scale + unit.offset
    if device:
        value = value / context.ratio if context.ratio > 0 else None
    elif root:
        value *= context.root
    elif axis:
        size = context.width if horizontal else context.height
        value = None if size is None else value * size
    return value


_SUBJECT = {
    "rect": r"(?:element\s+)?(?:rects?|positions?|rectangles?)",
    "box": r"(?:redaction\s+|mask\s+)?box(?:es)?",
    "viewport": r"(?:viewport|window)(?:\s+size)?",
}
_STATES = [
    (field, re.compile(pattern, re.I))
    for field, subject in _SUBJECT.items()
    for pattern in (rf"(?P<unit>.+?)\s+used\s+for\s+{subject}", rf"{subject}\s*(?::|\s(?:given\s+as|are|is|in)\s)\s*(?P<unit>.+?)(?:\s+here)?")
]
_CLAUSES = re.compile(r"\s*;\s*|\.\s+|\s+/\s+|\n+")


@lru_cache(maxsize=65536)
def stated_units(note: str | None) -> tuple[tuple[str, str], ...]:
    """(field, unit wording) pairs that a free-text note states for ``rect``, ``box`` and ``viewport``.

    Clauses are apart by ``;``, a full stop or a slash between spaces; a later clause on a field wins.
    """
    found: dict[str, str] = {}
    for clause in _CLAUSES.split((note or "").strip().rstrip(".")):
        for field, pattern in _STATES:
            m = pattern.fullmatch(clause)
            if m and parse_unit(m["unit"]) is not None:
                found[field] = m["unit"]
                break
    return tuple(sorted(found.items()))
