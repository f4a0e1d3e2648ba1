import glob
import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def _cell(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return str(list(v))
    if v is None or pd.isna(v):
        return None
    return repr(round(float(v), 8)) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)


def _normal(df):
    return sorted((tuple(map(_cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["kind", "hits", "texts"] and df.count() > 0


LLM = tuple(f"p{n}_" for n in range(3, 9))  # tested in tests/llm


@pytest.mark.parametrize("name", [n for n in sorted(entry.oracle_sql()) if not n.startswith(LLM)])
def test_against_sql(spark, oracle, name):
    ours, theirs = entry.queries()[name](spark, DATA).toPandas(), oracle.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _normal(ours) == _normal(theirs)


CORE = sorted(set(entry.queries()) - set(entry.oracle_sql()))


@pytest.mark.parametrize("name", [n for n in CORE if not n.startswith(LLM)])
def test_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() >= 0
