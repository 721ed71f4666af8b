"""Every library query against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from sparkloom.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def tidy(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda v: "null" if v is None or isinstance(v, (float, np.floating)) and np.isnan(v) else str(round(float(v), 6)) if isinstance(v, (float, np.floating)) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    assert len(got)
    if name in catalog.SQL:
        expected = tidy(duck.execute(catalog.SQL[name]).df())
        got = tidy(got)
        assert list(got.columns) == list(expected.columns)
        assert got.equals(expected)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
