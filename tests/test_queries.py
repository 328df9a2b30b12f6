"""Every query against its SQL in DuckDB, on the smallest tables: rows, columns and types."""

import numbers

import duckdb
import pandas as pd
import pytest

from sentrylake.plans import registry
from sentrylake.plans.analogues import FIXTURE_ORACLES, FIXTURES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, numbers.Number) and not isinstance(v, bool):
        return f"{float(v):.10g}"
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(map(cell, r)) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(FIXTURES))
def test_fixture(spark, duck, name):
    compare(duck, FIXTURES[name](spark, FOLDER), FIXTURE_ORACLES[name])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    if name not in registry.ORACLES:
        assert len(df.toPandas().columns)
        return
    compare(duck, df, registry.ORACLES[name])


def compare(duck, df, sql):
    got = df.toPandas()
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    kinds = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {sql}").fetchall()}
    assert {c: TYPES.get(k, k) for c, k in df.dtypes} == kinds
    assert rows(got) == rows(want)
