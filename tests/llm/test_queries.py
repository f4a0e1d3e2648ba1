import glob
import os

import duckdb
import pytest

from veilspark.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {"p3_found": ["field_name", "term", "verdict"], "p4_found": ["record_kind", "record_id", "elem_ord", "string_id"], "p5_found": ["record_kind", "record_id", "elem_ord", "pii_kind"], "p6_found": ["doc_id"], "p7_found": ["source"], "p8_found": ["doc_id"]}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    assert len(set(map(str, rows))) == len(rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, rows, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    ours, theirs = queries.QUERIES[name](spark, DATA), con.execute(queries.SQL[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    assert rows(ours.select(*columns)) == sorted(theirs.fetchall(), key=str)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data here")
def test_packing_and_mixing_figures(spark):
    """What pN_found cannot show: how full the containers are, and how near every budget is met."""
    folder = "/root/testdata/sf0.01"
    fill = queries.p6_fill(spark, folder).toPandas()
    assert (fill.containers <= 1.005 * -(-fill.tokens // fill.capacity_tokens)).all() and len(fill) == 3
    shares = queries.p7_shares(spark, folder).toPandas()
    sizes = queries._sizes(spark, folder, "source").toPandas()
    total = int(sizes[sizes.source.isin(shares.source)].tokens.sum())
    met = shares[shares.reachable]
    assert (met.used_tokens == (met.target_share * float(total)).astype(int)).all() and len(met) == 7  # to the token
