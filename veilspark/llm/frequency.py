"""Occurrences and record counts of every distinct term by a range-partitioned external sort and a run-length scan.

Pairs of term and record are range-partitioned on the whole pair and sorted
within partitions (Spark's external sort, which spills). All copies of a pair
so meet in one partition, while a term that is everywhere spreads over many:
its run is cut only between records. A scan over each sorted partition then
emits one row per term and partition, with run lengths as counts, and the few
partial rows of a term are added up. Nothing is collected and no group is held
in memory.

Defined results: null terms and null record ids count nowhere; the empty
string is a term; a (term, record, position) repeated by a second delivery
counts once; an empty table gives no rows; terms keep their exact spelling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNS = "field_name STRING, term STRING, occurrences BIGINT, records BIGINT"
_RUNS = pa.schema([("field_name", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def _changes(*columns: pa.ChunkedArray) -> np.ndarray:
    """Where a sorted batch has another value than the row before, in any column."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n > 1:
        same = np.ones(n - 1, bool)
        for c in columns:
            same &= pc.equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[1:] = ~same
    return new


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths over a sorted partition; state across batches is one open run."""
    open_run: list | None = None  # [field, term, occurrences, records, last record, last position]
    for batch in batches:
        if not batch.num_rows:
            continue
        field, term, record, position = batch.columns
        new_term = _changes(field, term)
        new_record = new_term | _changes(record)
        new_row = new_record | _changes(position)
        rec, pos = record.to_numpy(), position.to_numpy()
        starts = np.flatnonzero(new_term)
        occ, recs = np.add.reduceat(new_row.astype(np.int64), starts), np.add.reduceat(new_record.astype(np.int64), starts)
        names, terms = field.take(pa.array(starts)).to_pylist(), term.take(pa.array(starts)).to_pylist()
        out: list[list] = []
        for i, (f, t, o, r) in enumerate(zip(names, terms, occ.tolist(), recs.tolist())):
            end = (starts[i + 1] if i + 1 < len(starts) else batch.num_rows) - 1
            if open_run and open_run[:2] == [f, t]:
                same_record = open_run[4] == rec[starts[i]]
                open_run[2] += o - int(same_record and open_run[5] == pos[starts[i]])
                open_run[3] += r - int(same_record)
                open_run[4:] = [rec[end], pos[end]]
            else:
                if open_run:
                    out.append(open_run[:4])
                open_run = [f, t, o, r, rec[end], pos[end]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _RUNS.types)], schema=_RUNS)
    if open_run:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(open_run[:4], _RUNS.types)], schema=_RUNS)


def term_frequencies(pairs: DataFrame) -> DataFrame:
    """``RUNS`` for every (field_name, term) of ``pairs(field_name, term, record_id, position)``."""
    key = ["field_name", "term", "record_id", "position"]
    rows = pairs.select(F.col("field_name").cast("string"), F.col("term").cast("string"), F.col("record_id").cast("bigint"), F.coalesce(F.col("position").cast("bigint"), F.lit(0)).alias("position")).where("field_name IS NOT NULL AND term IS NOT NULL AND record_id IS NOT NULL")
    runs = rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_scan, RUNS)
    return runs.groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def request_terms(requests: DataFrame) -> DataFrame:
    """Pairs of the redaction items' ``label`` and ``source`` and the elements' ``tag``."""
    fields = {"label": "redaction_manifest.label", "source": "redaction_manifest.source", "tag": "dom_elements.tag"}
    columns = F.array(*(F.struct(F.lit(name).alias("field_name"), F.col(path).alias("terms")) for name, path in fields.items()))  # reads these leaves only
    return requests.select(F.col("request_id").alias("record_id"), F.explode(columns).alias("f")).select("record_id", "f.field_name", F.posexplode("f.terms").alias("position", "term"))


def mark_terms(frequencies: DataFrame, total_records: Column, rare_below: int = 5, common_above: float = 0.5) -> DataFrame:
    """With ``verdict``: ``rare``, ``common`` or ``useful``; a term can be both only in tiny tables, where ``rare`` wins."""
    verdict = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * total_records, "common").otherwise("useful")
    return frequencies.withColumn("verdict", verdict)
