"""The queries that SQL can express give the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tessera.llm.queries import ORACLE, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{FOLDER}/documents.parquet')")
    want, got = con.sql(ORACLE[name]).to_arrow_table(), QUERIES[name](spark, FOLDER).toArrow()
    names = sorted(want.column_names)
    assert sorted(got.column_names) == names
    plain = lambda t: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in zip(*[t.column(c).to_pylist() for c in names], strict=True)), key=repr)
    assert plain(got) == plain(want)
