"""From the elements of pages to sensitive boxes and to a minimal, scrubbed page model.

``elements`` and ``pages`` are the project's tables. Elements loaded twice
count once. All caps are per page and in document order, and a window limit
prunes them before the shuffle, so a page with a large share of all elements
costs no task more than its cap.

Defined results: null rects are not visible; pages without elements have no
digest row; null texts are empty; elements of pages that aren't listed are
left out; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import elements as E
from ..functions import geometry as G
from ..functions.text import scan_text, scrub_text

_COLUMNS = ("page_id", "ord", "tag", "type", "name", "id", "placeholder", "aria_label", "data_testid", "data_test", "aria_labelledby", "autocomplete", "role", "href", "value", "text", "rect", "hidden")
FORM_TAGS = ("input", "textarea", "select")


def attribute(name: str) -> Column:
    return F.col(name)


def latest(elements: DataFrame, columns: Sequence[str] = _COLUMNS) -> DataFrame:
    """One row per element, of its last load; rows alike in all but the time of loading aggregate map-side. Only ``columns`` are shuffled."""
    kept = [c for c in columns if c not in ("page_id", "ord")]
    first = ["text"] if "text" in kept else []  # of rows loaded at one time
    ranked = ["loaded_at", *first, *(c for c in kept if c not in first)]
    return elements.groupBy("page_id", "ord").agg(F.max(F.struct(*ranked)).alias("_e")).select("page_id", "ord", *(F.col(f"_e.{c}").alias(c) for c in kept))


def labelled_by(elements: DataFrame) -> DataFrame:
    """(page_id, ord, labels): texts of the elements that ``aria_labelledby`` names, in its order; unknown ids are skipped."""
    refs = elements.where(F.trim("aria_labelledby") != "").select("page_id", "ord", F.posexplode(F.filter(F.split("aria_labelledby", r"\s+"), lambda x: x != "")).alias("_at", "_id"))
    texts = elements.where("id <> ''").groupBy("page_id", F.col("id").alias("_id")).agg(F.min_by(F.coalesce("text", F.lit("")), "ord").alias("_text"))  # the first of an id counts
    found = refs.join(texts, ["page_id", "_id"])
    return found.groupBy("page_id", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda x: x["_text"]).alias("labels"))


def labels_for(elements: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, ord, labels): texts of ``labels(page_id, for_id, ord, text)`` that point to an element's id."""
    l = labels.select("page_id", F.col("for_id").alias("id"), F.col("ord").alias("_at"), F.coalesce("text", F.lit("")).alias("_text"))
    found = elements.where("id <> ''").select("page_id", "ord", "id").join(l, ["page_id", "id"])
    return found.groupBy("page_id", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda x: x["_text"]).alias("labels"))


def with_haystack(elements: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``elements`` with ``haystack``: attributes, labels pointing to it, then texts it is labelled by."""
    by = labelled_by(elements).withColumnRenamed("labels", "_by")
    joined = elements.join(by, ["page_id", "ord"], "left")
    texts = F.col("_by")
    if labels is not None:
        joined = joined.join(labels_for(elements, labels).withColumnRenamed("labels", "_for"), ["page_id", "ord"], "left")
        none = F.array().cast("array<string>")
        texts = F.concat(F.coalesce("_for", none), F.coalesce("_by", none))
    return joined.withColumn("haystack", E.haystack(attribute, texts)).drop("_by", "_for")


def classified(elements: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``elements`` with ``haystack`` and ``class`` (null if not sensitive)."""
    return with_haystack(elements, labels).withColumn("class", E.classify(attribute, F.col("haystack")))


def _with_view(elements: DataFrame, pages: DataFrame) -> DataFrame:
    return elements.join(pages.select("page_id", F.col("viewport_w").alias("_vw"), F.col("viewport_h").alias("_vh")).dropDuplicates(["page_id"]), "page_id")


def field_boxes(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Sensitive form controls with ``visible``; the hidden ones have no pixels but must not reach a text sink either."""
    c = classified(elements).where(F.col("tag").isin(*FORM_TAGS) & F.col("class").isNotNull())
    return _with_view(c, pages).select("page_id", "ord", "rect", "class.*", E.in_view(F.col("rect"), F.col("hidden"), F.col("_vw"), F.col("_vh")).alias("visible"))


def text_boxes(elements: DataFrame, pages: DataFrame, cap: int = 400) -> DataFrame:
    """Hits in the first ``cap`` texts of each page: of six characters at least, not in scripts, touching the screen."""
    t = elements.where((F.length(E.trim_all(F.col("text"))) >= 6) & ~F.coalesce(F.lower("tag").isin("script", "style", "noscript"), F.lit(False)))
    seen = t.withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))).where(F.col("_n") <= cap)
    hits = seen.select("page_id", "ord", "rect", F.explode(scan_text(F.col("text"))).alias("hit"))
    kind = F.col("hit.id")
    return _with_view(hits, pages).where(E.in_view_vertically(F.col("rect"), F.col("_vh"))).select("page_id", "ord", "rect", F.lit("L4").alias("layer"), "hit.confidence", kind.alias("kind"), F.concat(F.lit("text matched "), kind).alias("reason"))


def full_scan(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """All boxes to cover: visible fields and text hits."""
    return field_boxes(elements, pages).where("visible").drop("visible").unionByName(text_boxes(elements, pages))


def sensitive_elements_v1(elements: DataFrame) -> DataFrame:
    """Form controls the earlier classifier flags, if painted."""
    e = elements.where(F.col("tag").isin(*FORM_TAGS) & E.painted(F.col("rect"))).withColumn("v1", E.classify_v1(attribute))
    return e.where("v1.sensitive").select("page_id", "ord", "rect", F.col("v1.reason").alias("reason"))


def interactive_elements_v1(elements: DataFrame) -> DataFrame:
    """The earlier projection of interactive elements for an agent."""
    e = elements.where(E.interactive_v1(F.col("tag")) & E.painted(F.col("rect")))
    text = E.shown_text(E.trim_all(F.col("text")), F.col("value"), F.col("placeholder"), F.col("aria_label"))
    r = [G.round_half_up(F.col(f"rect.{n}")).cast("bigint").alias(n) for n in "xywh"]
    return e.select("page_id", "ord", "tag", F.coalesce("id", F.lit("")).alias("id"), F.coalesce("name", F.lit("")).alias("name"), "type", F.substring(F.coalesce(text, F.lit("")), 1, 80).alias("text"), E.selector(F.col("tag"), F.col("id"), F.col("name")).alias("selector"), *r)


def _clean(text: Column, most: int) -> Column:
    """Scrubbed, then cut, so that no identifier survives as a stump."""
    return F.substring(scrub_text(text)["text"], 1, most)


def digest_elements(elements: DataFrame, pages: DataFrame, cap: int = 150) -> DataFrame:
    """The first ``cap`` visible interactive elements of each page; a sensitive one never shows its value."""
    e = _with_view(elements.where(E.interactive(F.col("tag"), F.col("role"), F.col("href"))), pages).where(E.in_view_vertically(F.col("rect"), F.col("_vh")))
    e = e.withColumn("i", F.row_number().over(Window.partitionBy("page_id").orderBy("ord")) - 1).where(F.col("i") < cap)
    # labels come from all elements of the page, not from those that were kept
    e = e.join(labelled_by(elements).withColumnRenamed("labels", "_by"), ["page_id", "ord"], "left").withColumn("haystack", E.haystack(attribute, F.col("_by")))
    e = e.withColumn("class", E.classify(attribute, F.col("haystack")))
    shown_value = F.when(F.col("class").isNull() & F.length("value").between(1, 99), F.col("value"))
    # one lambda for all three texts: the scanner's expressions are planned once
    e = e.withColumn("_s", F.transform(F.array(F.col("haystack"), E.trim_all(F.col("text")), shown_value), lambda t: scrub_text(t)))
    value = F.when(F.col("class").isNotNull(), F.lit("[REDACTED:FIELD]")).otherwise(F.col("_s")[2]["text"])
    found = F.flatten(F.transform("_s", lambda x: F.coalesce(x["redactions"]["kind"], F.array().cast("array<string>"))))
    kinds = F.concat(found, F.when(F.col("class").isNotNull(), F.array(F.lit("field"))).otherwise(F.array().cast("array<string>")))
    r = F.struct(*(G.round_half_up(F.col(f"rect.{n}")).cast("bigint").alias(n) for n in "xywh"))
    return e.select(
        "page_id", "ord", "i", "tag", E.filled(F.col("type")).alias("type"), E.filled(F.col("role")).alias("role"), E.filled(F.substring(F.col("_s")[0]["text"], 1, 120)).alias("label"), E.filled(F.substring(F.col("_s")[1]["text"], 1, 120)).alias("text"),
        r.alias("rect"), F.col("class").isNotNull().alias("sensitive"), F.col("class.kind").alias("pii_kind"), value.alias("value"), kinds.alias("redacted_kinds"),
    )


def digest_headings(elements: DataFrame, cap: int = 20) -> DataFrame:
    """The first ``cap`` headings of each page that aren't empty."""
    h = elements.where(F.col("tag").isin("h1", "h2", "h3")).select("page_id", "ord", _clean(E.trim_all(F.col("text")), 100).alias("heading")).where("heading <> ''")
    return h.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))).where(F.col("n") <= cap)


def build_digest(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """One nested digest per page, with counts of what was redacted."""
    e = digest_elements(elements, pages)
    fields = F.struct("i", "tag", "type", "role", "label", "text", "rect", "sensitive", "pii_kind", "value")
    lists = e.groupBy("page_id").agg(F.array_sort(F.collect_list(fields)).alias("elements"), F.flatten(F.collect_list("redacted_kinds")).alias("_kinds"))
    by_kind = F.map_from_entries(F.transform(F.array_sort(F.array_distinct("_kinds")), lambda k: F.struct(k, F.size(F.filter("_kinds", lambda x: x == k)))))
    stats = F.struct(F.size("_kinds").alias("n"), by_kind.alias("by_kind"))
    heads = digest_headings(elements).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "heading"))), lambda x: x["heading"]).alias("headings"))
    p = pages.select("page_id", F.transform(F.array("url", "page_title"), lambda t: scrub_text(t)["text"]).alias("_s"), "viewport_w", "viewport_h")
    p = p.select("page_id", F.col("_s")[0].alias("url"), F.col("_s")[1].alias("title"), F.struct(F.col("viewport_w").alias("w"), F.col("viewport_h").alias("h")).alias("viewport"))
    j = p.join(lists, "page_id").join(heads, "page_id", "left")
    digest = F.struct("url", "title", "viewport", F.coalesce("headings", F.array().cast("array<string>")).alias("headings"), "elements")
    return j.select("page_id", digest.alias("digest"), stats.alias("stats"))


def latest_page(pages: DataFrame, by: str = "site", url: str = "url", seen: str = "first_seen") -> DataFrame:
    """The page seen last of each ``by``, the browser's own pages left out; ties go to the higher id."""
    return reachable_urls(pages, url).groupBy(by).agg(F.max(F.struct(seen, "page_id", url)).alias("_p")).select(by, F.col("_p.page_id").alias("page_id"), F.col(f"_p.{url}").alias(url))


def preview(text: Column, most: int = 4000) -> Column:
    """The beginning of a payload as it is shown to people, with what was left out as a number of characters."""
    return F.struct(F.substring(text, 1, most).alias("shown"), F.greatest(F.length(text) - most, F.lit(0)).alias("more"))


def reachable_urls(urls: DataFrame, column: str = "url") -> DataFrame:
    """Without the browser's own pages."""
    return urls.where(~F.col(column).rlike("^(chrome|edge|about|moz-extension|chrome-extension):"))
