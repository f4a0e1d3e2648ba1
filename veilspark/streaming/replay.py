"""Structured Streaming: event windows, bounded per-session history and redaction on the way.

Each function takes a streaming DataFrame and starts a query; :func:`run_available`
drains what a source holds, which is how the batch results are checked, and
``every`` (such as ``"3 seconds"``) keeps it running. Checkpoints and outputs
lie in the shared folder, so a restarted query goes on where it was.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import scrub_text
from ..session import shared_dir

HISTORY = "session BIGINT, n INT, p50 DOUBLE, p95 DOUBLE, last_ts TIMESTAMP, batch_rows INT"


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A table of the folder as a stream, whether it is one file or a folder of files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path) if not os.path.isfile(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Events and their values by type in tumbling windows; what is later than ``late`` is left out.

    With ``late=None`` nothing is, in whatever order the files come: for draining a table, as every window stays in the state.
    """
    return (events.withWatermark("ts", late) if late is not None else events).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def resource_summary(samples: DataFrame) -> DataFrame:
    """Per session of ``samples(session, at, used)``: readings so far, the first, the highest and the last of them by time, and the growth; zero and null readings are no readings."""
    s = samples.where("used > 0").groupBy("session").agg(F.count("*").alias("samples"), F.min_by("used", "at").alias("first"), F.max("used").alias("peak"), F.max_by("used", "at").alias("last"))
    return s.withColumn("delta", F.col("last") - F.col("first"))


def _history(size: int) -> Callable:
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stamps, values = (list(x) for x in state.get) if state.exists else ([], [])
        rows = 0
        for b in batches:
            rows += len(b)
            # cut after every piece of a batch, so that a session of any length stays small
            kept = sorted([*zip(stamps, values), *zip(b["ts"].astype("int64").tolist(), b["ms"].tolist())])[-size:]
            stamps, values = [s for s, _ in kept], [v for _, v in kept]
        state.update((stamps, values))
        p50, p95 = pd.Series(values).quantile([0.5, 0.95])
        yield pd.DataFrame({"session": [key[0]], "n": [len(values)], "p50": [p50], "p95": [p95], "last_ts": [pd.Timestamp(stamps[-1], unit="us")], "batch_rows": [rows]})

    return update


def bounded_history(timings: DataFrame, size: int = 500) -> DataFrame:
    """Per session, the last ``size`` timings as state, and their percentiles after every batch."""
    t = timings.select(F.col("session").cast("bigint"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("ms").cast("double")).where("ms IS NOT NULL AND ts IS NOT NULL")
    return t.groupBy("session").applyInPandasWithState(_history(size), HISTORY, "stamps ARRAY<BIGINT>, vals ARRAY<DOUBLE>", "update", GroupStateTimeout.NoTimeout)


def scrubbed(texts: DataFrame, column: str = "text") -> DataFrame:
    """A stream of texts with placeholders; stateless."""
    s = texts.withColumn("_s", scrub_text(F.col(column)))
    return s.withColumn(column, F.col("_s.text")).withColumn("redactions", F.coalesce(F.size("_s.redactions"), F.lit(0))).drop("_s")


def start(df: DataFrame, label: str, mode: str = "append", every: str | None = None) -> tuple[StreamingQuery, str]:
    """A query that writes parquet to a new shared folder, with its path. Modes other than append write one folder per batch."""
    out, checkpoint = shared_dir(df.sparkSession, f"{label}-out"), shared_dir(df.sparkSession, f"{label}-checkpoint")
    writer = df.writeStream.option("checkpointLocation", checkpoint).queryName(label + "-" + out[-8:]).outputMode(mode)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    if mode == "append":
        return writer.format("parquet").option("path", out).start(), out

    def save(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n:09d}")  # a repeated batch replaces itself

    return writer.foreachBatch(save).start(), out


def run_available(df: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Everything the source holds now, as the table that was written."""
    query, out = start(df, label, mode)
    query.awaitTermination()
    spark = df.sparkSession
    if mode == "append":
        return spark.read.schema(df.schema).parquet(out)
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*")


def last_of(updates: DataFrame, *key: str) -> DataFrame:
    """The latest row of each key."""
    columns = [c for c in updates.columns if c not in (*key, "batch")]
    return updates.groupBy(*key).agg(F.max_by(F.struct(*columns), "batch").alias("_r")).select(*key, "_r.*")
