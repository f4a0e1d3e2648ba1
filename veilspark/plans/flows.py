"""Queries of sources, sinks and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digest, evaluate, fusion
from ..session import shared_dir
from ..sources import html, json
from ..streaming import replay
from . import vision
from .measure import _cases
from .sqlgen import scrubbed_sql
from .tables import table


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts by type, kept up by a stream; the last update of each window equals the batch result."""
    events = replay.stream_table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = replay.last_of(replay.run_available(replay.windowed_counts(events, late=None), "windows", "update"), "start", "event_type")
    return out.select("start", "event_type", "n", F.round("total", 6).alias("total"))


def stream_history(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each session's last 500 timings, kept as state."""
    t = replay.stream_table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("ms"))
    return replay.last_of(replay.run_available(replay.bounded_history(t), "history", "update"), "session").select("session", F.col("n").cast("bigint").alias("n"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def stream_scrubbed_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks redacted on the way through a stream."""
    t = replay.stream_table(spark, d, "requests").select("request_id", F.col("task").alias("text")).where("text IS NOT NULL")
    return replay.run_available(replay.scrubbed(t), "tasks").where("redactions > 0").select("request_id", "text", F.col("redactions").cast("bigint").alias("n")).distinct()


def _pages_html(spark: SparkSession, d: str) -> DataFrame:
    """Each element's text within small markup, as a page of its own."""
    e = table(spark, d, "elements").where("text IS NOT NULL").select("page_id", "ord", "text").distinct()
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return e.select((F.col("page_id") * 100000000 + F.col("ord")).alias("page_id"), F.concat(F.lit("<div><script>var hidden = 1;</script><p class=x>"), escaped, F.lit('</p><input type="text" name="q"></div>')).alias("html"))


def html_text_nodes(spark: SparkSession, d: str) -> DataFrame:
    return html.acceptable(html.text_nodes(_pages_html(spark, d))).select("page_id", "parent_tag", "text")


def html_elements(spark: SparkSession, d: str) -> DataFrame:
    return html.html_elements(_pages_html(spark, d)).groupBy("tag").agg(F.count("*").alias("n"), F.count("name").alias("named"))


def request_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of the plain form, parsed with a schema; malformed ones are marked, not lost."""
    b = json.parse_requests(table(spark, d, "act_payloads").select("request_id", "body")).distinct()
    return b.groupBy("malformed").agg(F.countDistinct("request_id").alias("requests"))


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Case results written as JSON and read again."""
    path = shared_dir(spark, "cases")
    json.write_json(evaluate.per_case(_cases(spark, d)), path)
    back = spark.read.schema("request_id BIGINT, category STRING, tp BIGINT, fp BIGINT, fn BIGINT, precision DOUBLE, recall DOUBLE, f1 DOUBLE").json(path)
    return back.groupBy("category").agg(F.count("*").alias("cases"), F.sum("tp").alias("tp"), F.sum("fn").alias("fn"))


def partitioned_digest(spark: SparkSession, d: str) -> DataFrame:
    """Masks written partitioned by source and read back with partition pruning."""
    path = shared_dir(spark, "masks")
    json.write_parquet(fusion.manifest(vision._masks(spark, d)), path, "source")
    return spark.read.parquet(path).where("source = 'model'").groupBy("label").agg(F.count("*").alias("n"))


def interactive_counts(spark: SparkSession, d: str) -> DataFrame:
    """Interactive elements by tag under both definitions."""
    from ..functions import elements as E

    e = digest.latest(table(spark, d, "elements").select("page_id", "ord", "loaded_at", "tag", "role", "href"), ("tag", "role", "href"))
    return e.groupBy("tag").agg(F.count_if(E.interactive(F.col("tag"), F.col("role"), F.col("href"))).alias("now"), F.count_if(E.interactive_v1(F.col("tag"))).alias("earlier")).where("now > 0 OR earlier > 0")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (stream_windows, stream_history, stream_scrubbed_tasks, html_text_nodes, html_elements, request_bodies, json_round_trip, partitioned_digest, interactive_counts)}
_SPACE = "[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0085}]+"
SQL: dict[str, str] = {
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "stream_history": "SELECT session, count(*) AS n, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95 FROM (SELECT user_id AS session, value AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) AS k FROM events WHERE value IS NOT NULL) WHERE k <= 500 GROUP BY session",
    "stream_scrubbed_tasks": scrubbed_sql("request_id", "(SELECT DISTINCT request_id, task AS text FROM requests WHERE task IS NOT NULL)") + " SELECT request_id, text, n FROM e",
    "html_text_nodes": f"SELECT page_id * 100000000 + ord AS page_id, 'p' AS parent_tag, text FROM (SELECT DISTINCT page_id, ord, text FROM elements) WHERE length(regexp_replace(text, '^{_SPACE}|{_SPACE}$', '', 'g')) >= 6",
    "html_elements": "SELECT tag, n, CASE WHEN tag = 'input' THEN n ELSE 0 END AS named FROM (SELECT count(*) AS n FROM (SELECT DISTINCT page_id, ord, text FROM elements WHERE text IS NOT NULL)), (SELECT unnest(['div', 'script', 'p', 'input']) AS tag)",
    "request_bodies": "SELECT NOT coalesce(json_valid(body), false) AS malformed, count(DISTINCT request_id) AS requests FROM act_payloads GROUP BY 1",
    "json_round_trip": "WITH r AS (SELECT DISTINCT request_id, coalesce(client, '') AS category, coalesce(redaction_manifest, []) AS m FROM requests) SELECT category, count(*) AS cases, CAST(sum(len(list_filter(m, lambda x: lower(trim(x.source)) = 'dom'))) AS BIGINT) AS tp, CAST(sum(len(m) - len(list_filter(m, lambda x: lower(trim(x.source)) = 'dom'))) AS BIGINT) AS fn FROM r GROUP BY category",
    "partitioned_digest": vision._INPUTS + "SELECT kind AS label, count(*) AS n FROM masks WHERE source = 'model' GROUP BY kind",
    "interactive_counts": "SELECT * FROM (SELECT tag, CAST(count_if(coalesce(tag IN ('button', 'input', 'textarea', 'select'), false) OR coalesce(role IN ('button', 'link', 'textbox'), false) OR coalesce(tag = 'a' AND href IS NOT NULL, false)) AS BIGINT) AS now, CAST(count_if(coalesce(tag IN ('a', 'button', 'input', 'textarea', 'select'), false)) AS BIGINT) AS earlier FROM (SELECT DISTINCT page_id, ord, tag, role, href FROM elements) GROUP BY tag) WHERE now > 0 OR earlier > 0",
}
