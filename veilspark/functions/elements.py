"""Classifying form controls by a cascade of evidence, and describing them.

An element is a set of columns (or a struct) with the attributes ``type``,
``autocomplete``, ``name``, ``id``, ``placeholder``, ``aria_label``,
``data_testid``, ``data_test`` and ``value``. Null and empty attributes count alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import AUTOCOMPLETE_TOKENS, AUTOCOMPLETE_TOKENS_V1, INTERACTIVE_ROLES, INTERACTIVE_TAGS, NAME_PATTERN_V1, NAME_REGEX, jvm_regex
from .text import let, literals, scan_text

Attribute = Callable[[str], Column]
_ATTRIBUTES = ("name", "id", "placeholder", "aria_label", "data_testid", "data_test")


def filled(c: Column) -> Column:
    return F.when(c != "", c)


def trim_all(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def haystack(of: Attribute, labels: Column | None = None, most: int = 500) -> Column:
    """Everything that names an element, in order, apart by spaces: attributes, then label texts (an array)."""
    parts = F.array(*(filled(of(a)) for a in _ATTRIBUTES))
    if labels is not None:
        parts = F.concat(parts, F.transform(F.coalesce(labels, F.array().cast("array<string>")), filled))
    return F.substring(F.array_join(F.array_compact(parts), " "), 1, most)


def classify(of: Attribute, hay: Column) -> Column:
    """``struct<layer,confidence,kind,reason>`` by the first layer that speaks, or null.

    L1: a password field; L2: an autocomplete token, the first in list order;
    L3: a name pattern in the haystack, which leans towards recall (``author``
    holds ``auth``); L4: an identifier in the value of more than three characters.
    """
    auto = F.lower(of("autocomplete"))
    words = F.split(auto, r"\s+")
    token = F.get(F.filter(literals(AUTOCOMPLETE_TOKENS), lambda t: F.array_contains(words, t) | (t == auto)), F.lit(0))
    name = F.regexp_extract(hay, jvm_regex(NAME_REGEX, ignore_case=True), 0)

    def verdict(layer: str, confidence: Column, kind: Column, reason: Column) -> Column:
        return F.struct(F.lit(layer).alias("layer"), confidence.cast("double").alias("confidence"), kind.alias("kind"), reason.alias("reason"))

    l1 = F.when(F.lower(of("type")) == "password", verdict("L1", F.lit(1.0), F.lit("password"), F.lit('type="password"')))
    l2 = let(token, lambda t: F.when(t.isNotNull(), verdict("L2", F.lit(0.95), t, F.concat(F.lit('autocomplete="'), t, F.lit('"')))))
    l3 = let(name, lambda m: F.when(m != "", verdict("L3", F.lit(0.8), F.lower(m), F.concat(F.lit('label/name matched "'), m, F.lit('"')))))
    l4 = let(F.get(scan_text(F.when(F.length(of("value")) > 3, of("value"))), F.lit(0)), lambda h: F.when(h.isNotNull(), verdict("L4", h["confidence"], h["id"], F.concat(F.lit("value matched "), h["id"]))))
    return F.coalesce(l1, F.when(auto != "", l2), l3, l4)


def classify_v1(of: Attribute) -> Column:
    """The earlier cascade: ``struct<sensitive,reason>``; tokens match anywhere within the attribute."""
    auto = F.lower(F.coalesce(of("autocomplete"), F.lit("")))
    token = F.get(F.filter(literals(AUTOCOMPLETE_TOKENS_V1), lambda t: F.contains(auto, t)), F.lit(0))
    hay = F.array_join(F.array_compact(F.array(*(filled(of(a)) for a in ("name", "id", "placeholder", "aria_label")))), " ")
    yes = lambda reason: F.struct(F.lit(True).alias("sensitive"), reason.alias("reason"))
    return F.coalesce(
        F.when(F.lower(of("type")) == "password", yes(F.lit("type=password"))),
        let(token, lambda t: F.when(t.isNotNull(), yes(F.concat(F.lit("autocomplete="), t)))),
        F.when(hay.rlike(jvm_regex(NAME_PATTERN_V1, ignore_case=True)), yes(F.concat(F.lit('name/label match: "'), hay, F.lit('"')))),
        F.struct(F.lit(False).alias("sensitive"), F.lit(None).cast("string").alias("reason")),
    )


def interactive(tag: Column, role: Column, href: Column) -> Column:
    no = F.lit(False)
    return F.coalesce(tag.isin(*INTERACTIVE_TAGS), no) | F.coalesce(role.isin(*INTERACTIVE_ROLES), no) | F.coalesce((tag == "a") & href.isNotNull(), no)


def interactive_v1(tag: Column) -> Column:
    return F.coalesce(tag.isin("a", *INTERACTIVE_TAGS), F.lit(False))


def painted(rect: Column) -> Column:
    """Neither side is zero (the earlier test)."""
    return F.coalesce((rect["w"] != 0) & (rect["h"] != 0), F.lit(False))


def in_view_vertically(rect: Column, height: Column) -> Column:
    """It has a size and touches the screen from above to below; what lies beside it isn't asked."""
    return F.coalesce((rect["w"] > 0) & (rect["h"] > 0) & (rect["y"] + rect["h"] >= 0) & (rect["y"] <= height), F.lit(False))


def in_view(rect: Column, hidden: Column, width: Column, height: Column) -> Column:
    """It has a size, isn't hidden and touches the screen in both directions."""
    return in_view_vertically(rect, height) & ~F.coalesce(hidden, F.lit(False)) & F.coalesce((rect["x"] + rect["w"] >= 0) & (rect["x"] <= width), F.lit(False))


def selector(tag: Column, id: Column, name: Column, with_tag: bool = False) -> Column:
    """``#id``, else ``[name="..."]`` (after the tag if ``with_tag``), else the tag."""
    named = F.concat(tag if with_tag else F.lit(""), F.lit('[name="'), name, F.lit('"]'))
    return F.coalesce(F.concat(F.lit("#"), filled(id)), F.when(name != "", named), tag)


def shown_text(*candidates: Column) -> Column:
    """The first that isn't empty."""
    return F.coalesce(*map(filled, candidates))
