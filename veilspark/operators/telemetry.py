"""Timings of pipeline stages and frames: percentiles, steady state, cold start and bounded history.

``timings``: session, ts, stage, ms. ``frames``: session, ts, total, stages
(map of stage to ms). Percentiles interpolate linearly. Null timings are left
out; statistics over nothing are null; sessions of any length are ranked in
time order with ties by value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import STAGES
from ..functions.text import literals
from ..session import materialise


def round2(c: Column) -> Column:
    """To two places, halves up."""
    return F.floor(c * 100 + 0.5) / 100


def percentiles(values: DataFrame, by: str, value: str, *points: float) -> DataFrame:
    """(by, n, p50, ...): exact percentiles of a group of any size, picked by rank and interpolated linearly; no group is gathered in one task or buffer."""
    ranked = ordered(values.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("_v")), by, ["_v"], "_at")
    size = ranked.groupBy(by).agg((F.max("_at") + 1).alias("n")).withColumnRenamed(by, "_g")
    j = ranked.join(size, F.col(by).eqNullSafe(F.col("_g"))).drop("_g")
    at = lambda p: (F.col("n") - 1) * p
    value_at = lambda rank: F.max(F.when(F.col("_at") == rank, F.col("_v")))
    parts = [(value_at(F.floor(at(p))), value_at(F.ceil(at(p))), F.max(at(p) - F.floor(at(p)))) for p in points]
    return j.groupBy(by).agg(F.max("n").alias("n"), *(F.when(x == 0, low).otherwise((1 - x) * low + x * high).alias(f"p{int(p * 100)}") for p, (low, high, x) in zip(points, parts)))


def stage_percentiles(timings: DataFrame) -> DataFrame:
    """n, mean, p50 and p95 of every stage that has data."""
    t = timings.where("ms IS NOT NULL")
    means = t.groupBy("stage").agg(F.avg("ms").alias("mean")).withColumnRenamed("stage", "_g")
    p = percentiles(t, "stage", "ms", 0.5, 0.95)
    return p.join(means, F.col("stage").eqNullSafe(F.col("_g"))).select("stage", "n", "mean", "p50", "p95")


def frames_of(timings: DataFrame, key: Sequence[str] = ("session", "frame")) -> DataFrame:
    """Timings of a frame as one row: start, total and the map of its stages."""
    sums = timings.where("ms IS NOT NULL").groupBy(*key, "stage").agg(F.sum("ms").alias("ms"), F.min("ts").alias("ts"))
    return sums.groupBy(*key).agg(F.min("ts").alias("ts"), F.sum("ms").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "ms")))).alias("stages"))


def with_unaccounted(frames: DataFrame) -> DataFrame:
    """What a frame's total holds beyond its stages, never below 0."""
    spent = F.aggregate(F.map_values("stages"), F.lit(0.0), lambda a, v: a + v)
    return frames.withColumn("unaccounted", F.greatest(F.lit(0.0), F.col("total") - spent))


def ordered(df: DataFrame, by: str, keys: Sequence[str], name: str) -> DataFrame:
    """``df`` with the rank of each row within its ``by`` in order of ``keys``, from 0.

    Groups may be of any size, so they are not gathered in one task: rows are
    range-partitioned in order, ranked within their partition, and
    moved up by what the group has in the partitions before.
    """
    placed = materialise(df.repartitionByRange(by, *keys).withColumn("_p", F.spark_partition_id()), "ordinals")
    counts = placed.groupBy(by, "_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(by, "_p").orderBy(*keys))
    offsets = counts.select(F.col(by).alias("_s"), F.col("_p").alias("_q"), before.alias("_b"))
    same = F.col(by).eqNullSafe(F.col("_s")) & (F.col("_p") == F.col("_q"))
    ranked = placed.withColumn("_r", rank).join(offsets, same)
    return ranked.withColumn(name, F.col("_r") + F.col("_b") - 1).drop("_p", "_q", "_s", "_r", "_b")


def numbered(frames: DataFrame) -> DataFrame:
    """Frames with their ordinal within the session from 0, in order of time and total."""
    return ordered(frames, "session", ["ts", "total"], "ordinal")


def ring_buffer(frames: DataFrame, size: int = 500) -> DataFrame:
    """The last ``size`` frames of each session; a window limit prunes before the shuffle."""
    return frames.withColumn("_n", F.row_number().over(Window.partitionBy("session").orderBy(F.col("ts").desc(), F.col("total").desc()))).where(F.col("_n") <= size).drop("_n")


def steady_state(frames: DataFrame, warmup: int = 1) -> DataFrame:
    """By session: the cold frame's total, and statistics of those after the first ``warmup``."""
    n = materialise(numbered(frames).select("session", "ordinal", "total"), "numbered")
    late = F.when(F.col("ordinal") >= warmup, F.col("total"))
    s = n.groupBy("session").agg(F.min_by("total", "ordinal").alias("cold"), F.count(late).alias("n"), F.min(late).alias("fastest"), F.max(late).alias("slowest"))
    p = percentiles(n.where(F.col("ordinal") >= warmup), "session", "total", 0.5, 0.95).select(F.col("session").alias("_g"), "p50", "p95")
    return s.join(p, F.col("session").eqNullSafe(F.col("_g")), "left").select("session", "cold", "n", "p50", "p95", "fastest", "slowest", F.try_divide(F.lit(1000.0), F.col("p50")).alias("fps"))


def stage_share(frames: DataFrame) -> DataFrame:
    """Each stage's part of its frame, longest first (``place``)."""
    tall = frames.select("session", "frame", F.explode("stages").alias("stage", "ms"))
    frame = Window.partitionBy("session", "frame")
    total = F.sum("ms").over(frame)
    return tall.withColumn("share", F.col("ms") / F.when(total == 0, 1.0).otherwise(total)).withColumn("place", F.row_number().over(frame.orderBy(F.col("ms").desc(), "stage")))


def heap_summary(samples: DataFrame) -> DataFrame:
    """First, peak, last and growth of a memory reading by session; zero and null readings are no readings."""
    s = samples.where("used > 0").groupBy("session").agg(F.min_by("used", "at").alias("first"), F.max("used").alias("peak"), F.max_by("used", "at").alias("last"))
    return s.withColumn("delta", F.col("last") - F.col("first"))


def ordered_stages(frames: DataFrame) -> DataFrame:
    """Stages of the fixed vocabulary in their reporting order; others are left out."""
    return frames.withColumn("stages", F.map_from_entries(F.filter(F.transform(literals(STAGES), lambda s: F.struct(s.alias("key"), F.try_element_at("stages", s).alias("value"))), lambda e: e["value"].isNotNull())))


def console_lines(frames: DataFrame) -> DataFrame:
    """One readable line per frame."""
    parts = F.array_join(F.transform(F.map_entries("stages"), lambda e: F.format_string("%s %.1f", e["key"], e["value"])), ", ")
    return frames.select("session", "frame", F.format_string("frame %s: %.1f ms (%s)", F.col("frame").cast("string"), F.col("total"), parts).alias("line"))


def export(frames: DataFrame) -> DataFrame:
    """Frames as JSON rows, as a download would hold them."""
    return frames.select("session", "frame", F.to_json(F.struct(*frames.columns)).alias("json"))
