"""Every registered query with SQL gives the rows that DuckDB gives on the same tables; all others run and give rows."""

from __future__ import annotations

import os

import duckdb
import pytest

from tessera.plans.catalogue import ORACLE, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, list):
        return tuple(map(plain, value))
    return value


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(zip(*[[plain(x) for x in table.column(c).to_pylist()] for c in names], strict=True), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, FOLDER).toArrow()
    if name not in ORACLE:
        assert found.num_rows > 0
        return
    assert rows(found) == rows(duck.sql(ORACLE[name]).to_arrow_table())
