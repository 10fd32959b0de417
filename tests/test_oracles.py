"""Every query with SQL against DuckDB at the smallest scale; the others run and have rows or a stable schema."""

import datetime
import os

import duckdb
import pytest

from cairnspark.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, datetime.datetime):
        return repr(v.replace(tzinfo=None))
    return repr(float(v)) if type(v).__name__ == "Decimal" else repr(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
