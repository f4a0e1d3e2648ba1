"""Queries of the text scanner and redaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, udf
from ..functions.text import scan_text, scrub_text, strip_separators
from ..session import spread
from .sqlgen import hits_sql, luhn_sql, scrubbed_sql, verhoeff_sql
from .tables import table

# Texts with a known outcome. The first 13 hold an identifier, the next 8 do not; then overlaps, runs and boundaries.
SAMPLES = (
    "arjun.mehta@example.in", "7412 8536 0906", "7412 8536 1907", "ABCDE1234F", "QWERT5678G", "4111 1111 1111 1111", "5500 0055 5555 5559", "arjun.mehta@okicici", "arjun@paytm", "HDFC0001234",
    "SBIN0001234", "9876543210", "+91 9876543210", "1234 5678 1234 5678", "2345 6789 0123", "52,999", "REF-2026-00814", "TPX1C-16GB-512", "0900 to 1800 IST", "v4.11.2 build 20260415", "BR-4471",
    "order 999988887777666655554444", "no pii at all here", "123-45-6789", "Contact a@b.co or c@d.org today", "mail me at a@b.com ok", "ABCDE1234F@longcompany.com", "1.2.3.4.bob@secretdomain.com tail",
    "id 4111 1111 1111 1111 9876543210", "+919876543210", "host 10.0.0.255 and 10.0.0.256", "passport M1234567", "+1 (415) 555-0133 call", "card 4111 1111 1111 1111 ok", "",
)
_SAMPLES_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(SAMPLES)) + ") v(doc_id, text))"
_DIGITS = ("4111111111111111", "5500005555555559", "4111111111111112", "1234567890123", "741285360906", "741285361907", "234567890123", "12345", "0", "")


def samples(spark: SparkSession, d: str = "") -> DataFrame:
    return spark.createDataFrame(list(enumerate(SAMPLES)), "doc_id BIGINT, text STRING")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(key, text, tag) of all element texts and tasks; deliveries that were repeated come as often."""
    e = table(spark, d, "elements").select(F.concat_ws("-", "page_id", "ord").alias("key"), "text", F.coalesce("tag", F.lit("")).alias("tag"))
    t = table(spark, d, "requests").select(F.concat(F.lit("r"), "request_id").alias("key"), F.col("task").alias("text"), F.lit("task").alias("tag"))
    return spread(e.unionByName(t).where("text IS NOT NULL"))


def _flat(df: DataFrame, *keys: str) -> DataFrame:
    return df.where("text IS NOT NULL").select(*keys, F.inline(scan_text(F.col("text"))))


def _samples_hits(spark: SparkSession, d: str) -> DataFrame:
    return _flat(samples(spark), "doc_id")


def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id")


def scan_hits(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_texts(spark, d), "key", "tag").distinct()


def pii_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return scan_hits(spark, d).groupBy(F.col("id").alias("kind")).agg(F.count("*").alias("hits"), F.countDistinct("key").alias("texts"))


def kind_counts_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return scan_hits(spark, d).groupBy("tag", F.col("id").alias("kind")).agg(F.count("*").alias("hits"))


def _check_rows(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _DIGITS], "digits STRING")


def luhn_check(spark: SparkSession, d: str) -> DataFrame:
    return _check_rows(spark, d).select("digits", checks.luhn_valid(F.col("digits")).alias("valid"))


def verhoeff_check(spark: SparkSession, d: str) -> DataFrame:
    return _check_rows(spark, d).select("digits", checks.verhoeff_valid(F.col("digits")).alias("valid"))


def separators_stripped(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark).select("doc_id", strip_separators(F.col("text")).alias("stripped"))


def scrub_texts(spark: SparkSession, d: str) -> DataFrame:
    s = _texts(spark, d).select("key", scrub_text(F.col("text")).alias("s"))
    return s.where(F.size("s.redactions") > 0).select("key", "s.text", F.size("s.redactions").cast("bigint").alias("n")).distinct()


def scrub_samples(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark).select("doc_id", scrub_text(F.col("text")).alias("s"))
    return s.where(F.size("s.redactions") > 0).select("doc_id", "s.text", F.size("s.redactions").cast("bigint").alias("n"))


def scrub_stats_by_tag(spark: SparkSession, d: str) -> DataFrame:
    r = _texts(spark, d).select("key", "tag", F.posexplode(scrub_text(F.col("text"))["redactions"]).alias("i", "r")).dropDuplicates(["key", "i"])
    return r.groupBy("tag").agg(F.count("*").alias("redactions"), F.sum("r.length").alias("characters"))


def texts_with_pii(spark: SparkSession, d: str) -> DataFrame:
    """Keys of texts with a hit, as a semi join."""
    t = _texts(spark, d)
    return t.select("key", "tag").distinct().join(_flat(t, "key").select("key"), "key", "left_semi")


def texts_clean(spark: SparkSession, d: str) -> DataFrame:
    """Keys of texts without a hit, as an anti join."""
    t = _texts(spark, d)
    return t.select("key", "tag").distinct().join(_flat(t, "key").select("key"), "key", "left_anti")


def leak_audit(spark: SparkSession, d: str) -> DataFrame:
    """What a second scan still finds after redaction to a fixpoint of three passes: it must be nothing."""
    s = _texts(spark, d).select(scrub_text(F.col("text"), passes=3)["text"].alias("t"))
    return s.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.size(scan_text(F.col("t")))), F.lit(0)).alias("residual_hits"))


def scrub_json_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of any depth, scrubbed, with their counts by kind."""
    b = spread(table(spark, d, "act_payloads").select("request_id", "body")).distinct()
    return b.select("request_id", udf.scrub_json("body").alias("s")).where("s.json IS NOT NULL").select("request_id", "s.json", F.to_json("s.by_kind").alias("by_kind"))


def udtf_lateral(spark: SparkSession, d: str) -> DataFrame:
    udf.register_sql(spark)
    samples(spark).createOrReplaceTempView("veil_samples")
    return spark.sql("SELECT s.doc_id, r.kind, r.match, r.idx FROM veil_samples s, LATERAL scan_text_rows(s.text) r")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__.lstrip("_"): f
    for f in (scan_hits, scan_documents, _samples_hits, pii_kind_counts, kind_counts_by_tag, luhn_check, verhoeff_check, separators_stripped, scrub_texts, scrub_samples, scrub_stats_by_tag, texts_with_pii, texts_clean, leak_audit, scrub_json_bodies, udtf_lateral)
}
_T = "(SELECT DISTINCT concat_ws('-', page_id, ord) AS key, text, coalesce(tag, '') AS tag FROM elements WHERE text IS NOT NULL UNION ALL SELECT DISTINCT 'r' || request_id, task, 'task' FROM requests WHERE task IS NOT NULL)"
_DIGIT_ROWS = "(SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in _DIGITS) + ") v(digits))"
SQL: dict[str, str] = {
    "scan_hits": hits_sql("key, tag", _T),
    "scan_documents": hits_sql("doc_id", "documents"),
    "samples_hits": "SELECT CAST(doc_id AS BIGINT) AS doc_id, idx, ord, id, match, confidence FROM (" + hits_sql("doc_id", _SAMPLES_SQL) + ")",
    "udtf_lateral": "SELECT CAST(doc_id AS BIGINT) AS doc_id, id AS kind, match, idx FROM (" + hits_sql("doc_id", _SAMPLES_SQL) + ")",
    "pii_kind_counts": f"SELECT id AS kind, count(*) AS hits, count(DISTINCT key) AS texts FROM ({hits_sql('key', _T)}) GROUP BY id",
    "kind_counts_by_tag": f"SELECT tag, id AS kind, count(*) AS hits FROM ({hits_sql('key, tag', _T)}) GROUP BY ALL",
    "luhn_check": f"SELECT digits, coalesce({luhn_sql('digits')}, false) AS valid FROM {_DIGIT_ROWS}",
    "verhoeff_check": f"SELECT digits, CASE WHEN length(digits) = 12 THEN {verhoeff_sql('digits')} ELSE false END AS valid FROM {_DIGIT_ROWS}",
    "separators_stripped": f"SELECT CAST(doc_id AS BIGINT) AS doc_id, replace(replace(text, ' ', ''), '-', '') AS stripped FROM {_SAMPLES_SQL}",
    "scrub_texts": scrubbed_sql("key", _T) + " SELECT key, text, n FROM e",
    "scrub_samples": scrubbed_sql("doc_id", _SAMPLES_SQL) + " SELECT CAST(doc_id AS BIGINT) AS doc_id, text, n FROM e",
    "scrub_stats_by_tag": scrubbed_sql("key", _T) + f" SELECT tag, count(*) AS redactions, CAST(sum(stop - start) AS BIGINT) AS characters FROM c JOIN {_T} t USING (key) GROUP BY tag",
    "texts_with_pii": f"SELECT key, tag FROM {_T} WHERE key IN (SELECT key FROM ({hits_sql('key', _T)}))",
    "texts_clean": f"SELECT key, tag FROM {_T} WHERE key NOT IN (SELECT key FROM ({hits_sql('key', _T)}))",
    "leak_audit": "SELECT CAST((SELECT count(*) FROM elements WHERE text IS NOT NULL) + (SELECT count(*) FROM requests WHERE task IS NOT NULL) AS BIGINT) AS texts, CAST(0 AS BIGINT) AS residual_hits",
}
