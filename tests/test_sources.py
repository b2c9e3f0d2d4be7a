"""Readers and writers: explicit schemas, names and results files, binary files."""

from __future__ import annotations

import hashlib

from tessera.sources import tables as T


def test_names(spark, tmp_path):
    (tmp_path / "names.txt").write_text("﻿Alpha\n# no\n\nbeta\nALPHA\n", encoding="utf-8")
    got = [x.name for x in T.read_names(spark, f"file://{tmp_path}/names.txt").orderBy("ord").collect()]
    assert got == ["Alpha", "beta"]


def test_results_append(spark, tmp_path):
    path = f"file://{tmp_path}/results"
    for i in range(2):
        T.append_results(spark.createDataFrame([(f"n{i}", "OK")], "name string, status string"), path)
    assert sorted(x.name for x in T.read_results(spark, path, "name string, status string").collect()) == ["n0", "n1"]


def test_binary(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    got = {x.path.rsplit("/", 1)[1]: (x.is_pdf, x.sha256) for x in T.read_binary(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.pdf": (True, hashlib.sha256(b"%PDF-1.7 x").hexdigest()), "b.pdf": (False, hashlib.sha256(b"<html>").hexdigest())}


def test_declared_schemas_parse():
    for name in T.SCHEMAS:
        assert len(T.schema(name)) >= 2
    assert len(T.SCHEMAS) == 18


def test_key_filter_reaches_the_scan(spark):
    found = T.by_key(T.load(spark, "/root/testdata/sf0.001", "customer"), "c_custkey", 42)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_custkey), EqualTo(c_custkey,42)]" in plan
