"""Queries of the operators for language-model data (p3 to p8)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table
from ..session import materialise, spread
from . import frequency, mixing, normalize, packing, pii, stuffing, tokens


def element_texts(spark: SparkSession, d: str) -> DataFrame:
    """(record_kind, record_id, elem_ord, text) of ``elements`` and of ``requests.dom_elements``."""
    a = table(spark, d, "elements").select(F.lit("element").alias("record_kind"), F.col("page_id").alias("record_id"), F.col("ord").alias("elem_ord"), "text")
    r = table(spark, d, "requests").select("request_id", F.posexplode("dom_elements.text").alias("elem_ord", "text"))
    return a.unionByName(r.select(F.lit("dom_element").alias("record_kind"), F.col("request_id").alias("record_id"), "elem_ord", "text"))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "requests")
    total = requests.agg(F.countDistinct("request_id").alias("n")).scalar()
    return frequency.mark_terms(frequency.term_frequencies(frequency.request_terms(requests)), total)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).where("verdict <> 'useful'").select("field_name", "term", "verdict")


def p3_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return normalize.lookalikes(element_texts(spark, d), table(spark, d, "ui_strings")).select("record_kind", "record_id", "elem_ord", "string_id").distinct()


def p4_canonical_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose consistent form differs from what was recorded, with that form."""
    t = element_texts(spark, d).withColumn("canonical", normalize.canonical_text(F.col("text")))
    return t.where("canonical <> text").distinct()


def _pii_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts in which personal information is sought: those of the elements, and the tasks of the requests."""
    tasks = table(spark, d, "requests").select(F.lit("task").alias("record_kind"), F.col("request_id").alias("record_id"), F.lit(-1).alias("elem_ord"), F.col("task").alias("text"))
    return spread(element_texts(spark, d).unionByName(tasks).where(F.length("text") > 0))


def _pii_model(spark: SparkSession, d: str) -> pii.SkipChainCRF:
    return pii.model_for(table(spark, d, "known_people"), table(spark, d, "ui_strings"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    kinds = pii.kinds_column(F.col("text"), _pii_model(spark, d))
    found = _pii_texts(spark, d).select("record_kind", "record_id", "elem_ord", kinds.alias("kinds")).where("kinds IS NOT NULL")
    return found.select("record_kind", "record_id", "elem_ord", F.explode("kinds").alias("pii_kind")).distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts that hold personal information, with placeholders."""
    t = _pii_texts(spark, d).withColumn("redacted", pii.redacted_column(F.col("text"), _pii_model(spark, d)))
    return t.where("redacted <> text").distinct()


def _sizes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """(doc_id, ..., tokens) of all documents, written once: texts are counted once."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text", *columns))
    return materialise(docs.select("doc_id", *columns, tokens.token_count(F.col("text")).alias("tokens")), "token-sizes")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that packing had to split for the containers of ``wide``."""
    wide = table(spark, d, "pack_sizes").where("pack_id = 'wide'")
    return packing.pack(_sizes(spark, d), wide).where("piece > 0").select("doc_id").distinct()


def p6_places(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d), table(spark, d, "pack_sizes"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    packs = table(spark, d, "pack_sizes")
    return packing.fill_report(packing.pack(_sizes(spark, d), packs), packs)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.choose(_sizes(spark, d, "source"), table(spark, d, "mix_targets")).where("NOT reachable").select("source").distinct()


def p7_uses(spark: SparkSession, d: str) -> DataFrame:
    sizes = _sizes(spark, d, "source")
    return mixing.uses(sizes, materialise(mixing.choose(sizes, table(spark, d, "mix_targets")), "mix-choice"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.choose(_sizes(spark, d, "source"), targets), targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_pages(spark, d).where("stuffed").select("doc_id")


def p8_pages(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(spread(table(spark, d, "documents").select("doc_id", "text", "lang")))


_TERMS = """WITH r AS (SELECT DISTINCT request_id, dom_elements, redaction_manifest FROM requests),
m AS (SELECT request_id, unnest(redaction_manifest) AS e, unnest(range(len(redaction_manifest))) AS pos FROM r),
el AS (SELECT request_id, unnest(dom_elements) AS e, unnest(range(len(dom_elements))) AS pos FROM r),
t AS (SELECT DISTINCT 'label' AS field_name, e.label AS term, request_id, pos FROM m UNION ALL SELECT DISTINCT 'source', e.source, request_id, pos FROM m UNION ALL SELECT DISTINCT 'tag', e.tag, request_id, pos FROM el),
c AS (SELECT field_name, term, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT request_id) AS BIGINT) AS records FROM t WHERE term IS NOT NULL GROUP BY ALL),
v AS (SELECT *, CASE WHEN records < 5 THEN 'rare' WHEN records > 0.5 * (SELECT count(DISTINCT request_id) FROM requests) THEN 'common' ELSE 'useful' END AS verdict FROM c)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_term_counts, p4_found, p4_canonical_texts, p5_found, p5_redacted, p6_found, p6_places, p6_fill, p7_found, p7_uses, p7_shares, p8_found, p8_pages)}
SQL: dict[str, str] = {
    "p3_found": _TERMS + "SELECT field_name, term, verdict FROM v WHERE verdict <> 'useful'",
    "p3_term_counts": _TERMS + "SELECT * FROM v",
}
