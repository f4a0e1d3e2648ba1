import random
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from veilspark.llm import frequency

PAIRS = "field_name STRING, term STRING, record_id BIGINT, position INT, occurrences STRING"


def _brute(rows):
    seen, records = defaultdict(set), defaultdict(set)
    for f, t, r, p, *_ in rows:
        if f is not None and t is not None and r is not None:
            seen[f, t].add((r, p))
            records[f, t].add(r)
    return sorted((f, t, len(seen[f, t]), len(records[f, t])) for f, t in seen)


def test_counts_equal_brute_force(spark, rows):
    r = random.Random(1)
    data = [(r.choice("ab"), r.choice(["hot"] * 6 + ["", "x", "Hot", "hot ", None, "é"]), r.choice([None, *range(60)]), r.randrange(4), "clash") for _ in range(4000)]
    df = spark.createDataFrame(data, PAIRS).repartition(7)
    assert rows(frequency.term_frequencies(df)) == sorted(_brute(data), key=str)
    assert frequency.term_frequencies(df.limit(0)).count() == 0


def test_runs_across_batches():
    data = sorted((f, t, r, p) for f in "ab" for t in ("x", "y") for r in range(5) for p in (0, 0, 1))
    batches = [pa.RecordBatch.from_pylist([dict(zip(("f", "t", "r", "p"), x)) for x in data[i : i + 4]]) for i in range(0, len(data), 4)]
    got = [tuple(x.values()) for b in frequency._scan(iter([batches[0].slice(0, 0), *batches])) for x in b.to_pylist()]
    assert sorted(got) == _brute(data)


def test_marks(spark, rows):
    f = spark.createDataFrame([("tag", "a", 9, 4), ("tag", "b", 9, 5), ("tag", "c", 9, 10), ("tag", "d", 9, 11)], frequency.RUNS)
    assert [r[1::3] for r in rows(frequency.mark_terms(f, F.lit(20)))] == [("a", "rare"), ("b", "useful"), ("c", "useful"), ("d", "common")]


def test_request_terms_with_nulls(spark, rows):
    s = "request_id BIGINT, dom_elements ARRAY<STRUCT<tag: STRING>>, redaction_manifest ARRAY<STRUCT<source: STRING, label: STRING>>"
    df = spark.createDataFrame([(1, [("a",), None, ("a",)], [(None, "x")]), (1, [("a",), None, ("a",)], [(None, "x")]), (2, None, None), (3, [], [])], s)
    assert rows(frequency.term_frequencies(frequency.request_terms(df))) == [("label", "x", 1, 1), ("tag", "a", 2, 1)]
