"""Every query with a DuckDB twin gives the twin's rows on the smallest tables; the others give rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from seismark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False):
        out.append(tuple(None if x is None or x is pd.NA or x != x else round(float(x), 9) if isinstance(x, (float, np.floating)) else str(x) if isinstance(x, np.ndarray | list) else int(x) if isinstance(x, np.integer) else x for x in row))
    return sorted(out, key=str)


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for name in (*TABLES, "embeddings"):
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return connection


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name]).df()
        assert len(want) and rows(got) == rows(want)
    else:
        assert len(got)


def test_entry_registers_all():
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
