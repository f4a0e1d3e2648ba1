"""Ranking the elements of a request against its task, within each request row.

Everything is an expression over the request's own arrays, so a request is
ranked where it lies and nothing is shuffled. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, literals

# Words that call for a click, and those that name no element.
CLICK_WORDS = ("click", "press", "submit", "confirm", "authenticate", "login", "button")
STOP_WORDS = ("click", "press", "the", "button")
TYPE_REGEX = r"(?i)(?:fill|enter|type|input)\s+([a-zA-Z0-9_\s]+?)(?:\s+with|\s+as|\s*:\s*)\s*(.*)"
ACTION = "struct<type:string,selector:string,x:int,y:int,value:string,confidence:double>"


def keywords(task: Column) -> Column:
    """Words of three letters or more, repeated ones as often."""
    return F.regexp_extract_all(F.lower(task), F.lit(r"(?U)\b\w{3,}\b"), F.lit(0))


def _hay(e: Column) -> Column:
    none = F.lit("")
    return F.lower(F.concat_ws(" ", *(F.coalesce(e[n], none) for n in ("text", "id", "name", "selector"))))


def element_score(e: Column, words: Column) -> Column:
    """Two for every word found in the element, one more if it is made to be clicked."""
    hay = _hay(e)
    found = F.size(F.filter(words, lambda w: ~w.isin(*STOP_WORDS) & F.contains(hay, w))) * 2
    return found + F.when(e["tag"].isin("button", "a") | (e["type"] == "submit"), 1).otherwise(0)


def best_element(elements: Column, words: Column) -> Column:
    """``struct<score,e>`` of the highest score above zero; the first wins a tie."""
    kind = F.transform(elements, lambda e: F.struct(element_score(e, words).alias("score"), e.alias("e")))
    top = lambda scored: let(F.array_max(F.transform(scored, lambda s: s["score"])), lambda m: F.get(F.filter(scored, lambda s: (s["score"] == m) & (m > 0)), F.lit(0)))
    return let(kind, top)


def _action(type_: str, selector: Column | None = None, x: Column | None = None, y: Column | None = None, value: Column | None = None, confidence: Column | float = 0.0) -> Column:
    null = F.lit(None)
    confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(F.lit(type_).alias("type"), (null if selector is None else selector).cast("string").alias("selector"), (null if x is None else x).cast("int").alias("x"), (null if y is None else y).cast("int").alias("y"), (null if value is None else value).cast("string").alias("value"), confidence.cast("double").alias("confidence"))


def _own_selector(e: Column) -> Column:
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(e["selector"]), F.concat(F.lit("#"), filled(e["id"])), e["tag"])


def _centre(r: Column) -> tuple[Column, Column]:
    part = lambda n: F.coalesce(r[n], F.lit(0.0))
    return F.when(r.isNotNull(), part("left") + part("width") / 2), F.when(r.isNotNull(), part("top") + part("height") / 2)


def rank_action(task: Column, elements: Column) -> Column:
    """The first rule that applies: scroll, click, type into a field, the first button, finish."""
    low = F.lower(F.coalesce(task, F.lit("")))
    elements = F.filter(F.coalesce(elements, F.array()), lambda e: e.isNotNull())
    words = keywords(low)
    scroll = F.when(F.contains(low, F.lit("scroll down")), _action("scroll", x=F.lit(0), y=F.lit(500), confidence=0.95)).when(F.contains(low, F.lit("scroll up")), _action("scroll", x=F.lit(0), y=F.lit(-500), confidence=0.95))
    wants_click = F.exists(literals(CLICK_WORDS), lambda k: F.contains(low, k))

    def click_on(b: Column) -> Column:
        x, y = _centre(b["e"]["rect"])
        return F.when(b.isNotNull(), _action("click", _own_selector(b["e"]), x, y, confidence=F.least(F.lit(0.75) + b["score"] * 0.08, F.lit(0.99))))

    click = F.when(wants_click, let(best_element(elements, words), click_on))
    field = F.lower(F.trim(F.regexp_extract(task, TYPE_REGEX, 1)))
    parts = F.filter(F.split(field, r"\s+"), lambda p: p != "")

    def holds(e: Column) -> Column:
        hay = F.lower(F.concat_ws(" ", *(F.coalesce(e[n], F.lit("")) for n in ("name", "id", "text", "selector"))))
        return F.exists(parts, lambda p: F.contains(hay, p))

    type_ = F.when(task.rlike(TYPE_REGEX), let(F.get(F.filter(elements, holds), F.lit(0)), lambda e: F.when(e.isNotNull(), _action("type", e["selector"], value=F.trim(F.regexp_extract(task, TYPE_REGEX, 2)), confidence=0.92))))
    first = F.get(F.filter(elements, lambda e: F.coalesce((e["tag"] == "button") | (e["type"] == "submit"), F.lit(False))), F.lit(0))
    at = lambda e, n: F.when(e["rect"].isNotNull(), F.coalesce(e["rect"][n], F.lit(100.0)))
    default = let(first, lambda e: F.when(e.isNotNull(), _action("click", _own_selector(e), at(e, "left"), at(e, "top"), confidence=0.8)))
    return F.coalesce(scroll, click, type_, default, _action("finish", confidence=0.5))


def act(requests: DataFrame) -> DataFrame:
    """Each request's action, and an audit that counts what is really there."""
    image = F.coalesce(F.length("sanitized_image_base64"), F.lit(0))
    return requests.select("request_id", rank_action(F.col("task"), F.col("dom_elements")).alias("a"), F.coalesce(F.size("redaction_manifest"), F.lit(0)).alias("redacted_regions"), image.alias("image_chars"), (image > 100).alias("has_image")).select("request_id", "a.*", "redacted_regions", "image_chars", "has_image")


def target_of(elements: Column, selector: Column, x: Column, y: Column) -> Column:
    """``struct<at,how>``: the position of the element an action means, or null.

    The first element in document order that the selector names (its own
    selector, ``#id``, ``[name="..."]`` or its tag); if there is none, or no
    selector, the last one that lies under the point, as later ones are drawn
    above. A selector that cannot be read names nothing. Null elements and
    rects keep their position and are never meant.
    """
    named = lambda e: (e["selector"] == selector) | (F.concat(F.lit("#"), e["id"]) == selector) | (F.concat(F.lit('[name="'), e["name"], F.lit('"]')) == selector) | (e["tag"] == selector)
    r = lambda e, n: e["rect"][n]
    under = lambda e: (x >= r(e, "left")) & (x < r(e, "left") + r(e, "width")) & (y >= r(e, "top")) & (y < r(e, "top") + r(e, "height"))
    spots = lambda test: F.filter(F.transform(elements, lambda e, i: F.when(F.coalesce(test(e), F.lit(False)), i)), lambda i: i.isNotNull())
    by_name, by_point = F.array_min(spots(named)), F.array_max(spots(under))
    return F.when(by_name.isNotNull(), F.struct(by_name.alias("at"), F.lit("selector").alias("how"))).when(by_point.isNotNull(), F.struct(by_point.alias("at"), F.lit("point").alias("how")))


def resolve_targets(requests: DataFrame) -> DataFrame:
    """Each request's action with the element it is dispatched to, within the request's row: (request_id, type, selector, x, y, at, how)."""
    a = requests.select("request_id", "dom_elements", rank_action(F.col("task"), F.col("dom_elements")).alias("a"))
    return a.select("request_id", "a.type", "a.selector", "a.x", "a.y", target_of(F.col("dom_elements"), F.col("a.selector"), F.col("a.x"), F.col("a.y")).alias("t")).select("request_id", "type", "selector", "x", "y", "t.at", "t.how")
