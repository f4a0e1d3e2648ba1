import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from veilspark.functions.units import Context, parse_quantity, parse_unit, stated_units, to_length

VIEW = Context(1000.0, 500.0, 2.0, 20.0)


@pytest.mark.parametrize(
    "text, px",
    [
        ("1 in", 96), ("72pt", 96), ("25.4 mm", 96), ("2.54cm", 96), ("1440 twips", 96), ("6 pc", 96), ("10px", 10), ("10 px (CSS)", 10), ("10 device px", 5), ("10 physical pixels", 5), ("2 rem", 40), ("2 root em", 40),
        ("10 % of viewport", 100), ("10 percent of the viewport", 100), ("0.5 viewport fraction 0..1", 500), ("1000 hundredths of a percent of the viewport", 100), ("254 tenths of a millimetre", 96), ("100 hundredths of an inch", 96),
    ],
)
def test_lengths(text, px):
    number, unit = parse_quantity(text)
    assert math.isclose(to_length(number, unit, VIEW, True), px)


def test_leading_scales():
    assert math.isclose(to_length(254, parse_unit("0.1 mm"), VIEW, True), 96)
    assert math.isclose(to_length(1440, parse_unit("1/1440 in"), VIEW, True), 96)
    assert math.isclose(to_length(1000, parse_unit("0.01 % of viewport"), VIEW, False), 50)


def test_vectors_and_offsets():
    f = parse_unit("degrees F")
    assert math.isclose(212 * f.scale + f.offset, 373.15)
    assert parse_unit("km/h").dims == parse_unit("metres per second").dims
    assert parse_unit("m^2").dims[0] == 2 and parse_unit("m^-1").dims[0] == -1
    assert parse_unit("degrees C per minute").offset == 0
    assert to_length(1, parse_unit("kg"), VIEW, True) is None and to_length(1, parse_unit("cm^2"), VIEW, True) is None


@pytest.mark.parametrize("text", [None, "", " ", "furlongs", "px px-ish 3..", "/", "in ^", "%%%&"])
def test_unreadable(text):
    assert parse_unit(text) is None
    assert parse_quantity(text) is None


def test_quantities_without_number():
    assert parse_quantity(True) is None and parse_quantity(float("nan")) is None and parse_quantity("1e999") is None
    assert parse_quantity("12") == (12.0, None) and parse_quantity(-3) == (-3.0, None)
    assert to_length(3, None, VIEW, True) is None
    assert to_length(3, parse_unit("% of viewport"), Context(), True) is None


def test_notes():
    note = "overlay on; viewport size in in. rects: % of viewport / 0.01 in used for mask boxes"
    assert dict(stated_units(note)) == {"viewport": "in", "rect": "% of viewport", "box": "0.01 in"}
    assert stated_units(None) == () and stated_units("model warm") == ()
    assert dict(stated_units("boxes are 1/1440 in here")) == {"box": "1/1440 in"}


@given(st.text(max_size=60))
def test_never_raises(text):
    parse_unit(text), parse_quantity(text), stated_units(text)
