"""Every fund query against its DuckDB twin on the same files."""

import math
import os

import duckdb
import pytest

from navloom.plans import registry
from navloom.plans.fixtures import fund_tables
from navloom.plans.registry import ORACLE_SQL, QUERIES
from navloom.sources import queries as sources


def cells(rows, columns):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f[:-8]} as select * from read_parquet('{sf_dir}/{f}')")
    return con


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    """The fund tables, computed once for all queries."""
    return {name: df.cache() for name, df in fund_tables(spark, sf_dir).items()}


@pytest.fixture
def shared(tables, monkeypatch):
    for module in (registry, sources):
        monkeypatch.setattr(module, "fund_tables", lambda spark, sf_dir: tables)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, shared, name):
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert cells(got, df.columns) == cells(want.fetchall(), want.columns)
    else:
        assert name in {"fx04_style_weights", "fx04_current_mix", "fx05_attribution", "e2e03_allocation_skill"}
