"""Every registered query that has equivalent SQL against DuckDB on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from wayfault.plans import catalogue, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float, Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0
    return str(v)


#: Types as the two systems name them.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_duckdb(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in want.description]
    assert {n: TYPES[t] for n, t in got.dtypes} == {r[0]: r[1] for r in duck.execute(f"DESCRIBE {registry.ORACLE[name]}").fetchall()}
    want = duck.execute(registry.ORACLE[name])
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0
