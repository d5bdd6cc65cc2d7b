"""Every query of the subpackage that has SQL, and whole given tables, against DuckDB."""

import os

import duckdb
import pytest

from tests.test_oracle import TYPES, rows
from wayfault.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_duckdb(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    want = want.fetchall()
    assert {n: TYPES[t] for n, t in got.dtypes} == {r[0]: r[1] for r in duck.execute(f"DESCRIBE {queries.ORACLE[name]}").fetchall()}
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, want)
