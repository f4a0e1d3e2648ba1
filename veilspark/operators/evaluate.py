"""Precision, recall and their kin, per case, per group and over all.

``cases``: tp, fp, fn (counts) and any keys. Per case, precision and recall are
1 where nothing was to be found or reported, and F1 is 0 where both are 0.
Null counts are 0; an empty table gives no rows (per case) or one of zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fusion


def _ratio(a: Column, b: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    precision, recall = _ratio(tp, tp + fp, 1.0), _ratio(tp, tp + fn, 1.0)
    return [precision.alias("precision"), recall.alias("recall"), _ratio(2 * precision * recall, precision + recall, 0.0).alias("f1")]


def per_case(cases: DataFrame) -> DataFrame:
    """Every case with its precision, recall and F1."""
    filled = cases.fillna(0, ["tp", "fp", "fn"])
    return filled.select("*", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def by(cases: DataFrame, *keys: str) -> DataFrame:
    """Micro-averaged scores by ``keys`` (none: over all cases)."""
    sums = cases.groupBy(*keys).agg(F.count("*").alias("cases"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    return sums.select("*", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def confusion(labelled: DataFrame, expected: str, found: str) -> DataFrame:
    """tp, fn, tn, fp over rows with two booleans; a ratio over nothing is 0."""
    e, f = F.col(expected), F.col(found)
    c = labelled.agg(F.count_if(e & f).alias("tp"), F.count_if(e & ~f).alias("fn"), F.count_if(~e & ~f).alias("tn"), F.count_if(~e & f).alias("fp"))
    part = lambda n, *of: F.col(n) / F.greatest(sum((F.col(x) for x in of[1:]), F.col(of[0])), F.lit(1))
    return c.withColumn("precision", part("tp", "tp", "fp")).withColumn("recall", part("tp", "tp", "fn")).withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def box_cases(truth: DataFrame, detected: DataFrame, above: float = 0.5) -> DataFrame:
    """Cases by frame: a true box is found, and a detected one right, if one of the other kind overlaps it by more than ``above``."""
    found, right = fusion.overlapping(truth, detected, above), fusion.overlapping(detected, truth, above)
    count = lambda df, name: df.groupBy("frame_id").agg(F.count("*").alias(name))
    j = count(truth, "all_true").join(count(detected, "all_detected"), "frame_id", "full").join(count(found, "tp"), "frame_id", "left").join(count(right, "right"), "frame_id", "left").fillna(0)
    return j.select("frame_id", "tp", (F.col("all_detected") - F.col("right")).alias("fp"), (F.col("all_true") - F.col("tp")).alias("fn"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, repeated rows as often."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))
