"""Readers and writers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANNOTATIONS = "id STRING, category STRING, name STRING, description STRING, ground_truth_pii ARRAY<STRUCT<type: STRING, label: STRING, box: ARRAY<INT>>>"
CASE_RESULTS = "id STRING, name STRING, category STRING, ground_truth_pii INT, detected_pii INT, tp INT, fp INT, fn INT, precision DOUBLE, recall DOUBLE, f1_score DOUBLE"
ACT_REQUEST = "task STRING, sanitized_image_base64 STRING, dom_elements ARRAY<STRUCT<tag: STRING, id: STRING, name: STRING, type: STRING, text: STRING, selector: STRING, rect: STRUCT<left: DOUBLE, top: DOUBLE, width: DOUBLE, height: DOUBLE>, is_interactive: BOOLEAN>>, redaction_manifest ARRAY<STRUCT<source: STRING, label: STRING, box: ARRAY<INT>>>, viewport MAP<STRING, DOUBLE>, url STRING"


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Cases with their true boxes; records that don't fit the schema keep their text in ``_corrupt``."""
    return spark.read.schema(ANNOTATIONS + ", _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True)


def annotation_boxes(cases: DataFrame) -> DataFrame:
    """One row per true box."""
    return cases.select("id", "category", F.posexplode("ground_truth_pii").alias("ord", "t")).select("id", "category", "ord", "t.type", "t.label", "t.box")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a results file."""
    return spark.read.schema(f"case_by_case ARRAY<STRUCT<{', '.join(f.replace(' ', ': ', 1) for f in CASE_RESULTS.split(', '))}>>").json(path, multiLine=True).select(F.inline("case_by_case"))


def parse_requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Bodies as typed columns; ``malformed`` marks those that aren't JSON, ``plain`` those that fit the schema as they are."""
    parsed = bodies.withColumn("_r", F.from_json(body, ACT_REQUEST + ", _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.withColumn("malformed", F.try_parse_json(body).isNull()).withColumn("plain", F.col("_r").isNotNull() & F.col("_r._bad").isNull()).select(*bodies.columns, "malformed", "plain", *(F.col(f"_r.{f.split()[0]}").alias(f"parsed_{f.split()[0]}") for f in ("task s", "dom_elements a", "redaction_manifest a", "url s")))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
