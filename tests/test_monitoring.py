"""Failures kept apart: injected callables, parsed pages, a monitoring cycle; contents stored once."""

from __future__ import annotations

import hashlib
import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import types as T

from tessera.operators import callables as C
from tessera.operators import monitoring as M
from tessera.sources import blobs

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import this module

RESULT = "name string not null, n long, scores array<double>, inner struct<ok: boolean>"


def test_results_under_a_schema(spark):
    kind = T.StructType.fromDDL(RESULT)
    assert C.fitted({"name": "x", "scores": [1, 2.5, None], "more": 3}, kind) == {"name": "x", "n": None, "scores": [1.0, 2.5, None], "inner": None}
    for bad, at in (({}, "result.name"), ({"name": 1}, "result.name"), ({"name": "x", "n": 1.5}, "result.n"), ({"name": "x", "n": True}, "result.n"), ({"name": "x", "n": 1 << 63}, "result.n"), ({"name": "x", "scores": ["1"]}, "result.scores[0]"), ({"name": "x", "inner": {"ok": 1}}, "result.inner.ok"), ([], "result")):
        with pytest.raises(ValueError, match=at.replace("[", r"\[").replace("]", r"\]")):
            C.fitted(bad, kind)


def analyser(text):
    if "fail" in text:
        raise KeyError(text)
    if "json" in text:
        return json.dumps({"name": text})
    if "odd" in text:
        return "no json"
    return {"name": text, "n": len(text)}


def test_called_in_order(spark):
    rows = [(1, i, f"t{i}", "own") for i in range(40)] + [(2, 3, "fail late", "own"), (2, 1, "fail early", "own"), (2, 0, "fine", "own"), (3, 0, "json", "own"), (4, 0, "odd", "own"), (5, 0, None, "own")]
    table = spark.createDataFrame(rows, "doc long, part int, text string, value string").repartition(6)
    answers = C.called(table, "text", analyser, RESULT)
    assert answers.columns == ["doc", "part", "text", "value", "error"]
    got = {x.doc: x for x in C.in_order(answers, "doc", "part").collect()}
    assert [x.name for x in got[1].results] == [f"t{i}" for i in range(40)] and got[1].error is None
    assert got[2].results is None and got[2].error == "KeyError: 'fail early'"
    assert got[3].results[0].name == "json" and got[4].error.startswith("JSONDecodeError") and got[5].results == [None]
    with pytest.raises(RuntimeError, match="doc 2, part 1: KeyError"):
        C.raise_first(answers, "doc", "part")
    C.raise_first(answers.where("doc = 1"), "doc", "part")
    with pytest.raises(TypeError):
        C.called(table, "text", "no callable", RESULT)
    assert C.called(table.limit(0), "text", analyser, RESULT).count() == 0


def parse(x):
    if x.startswith("bad"):
        raise ValueError("page")
    return x


def extract(text):
    if "boom" in text:
        raise RuntimeError("no model")
    if "odd" in text:
        return {"eligibility_rules": "seven"}
    return {"title": text[:5], "eligibility_rules": len(text)}


def test_cycle(spark):
    sha = lambda *pages: hashlib.sha256("\f".join(pages).encode()).hexdigest()
    pages = [(1, 2, "two"), (1, 1, "one"), (2, 1, "changed"), (2, 2, "bad page"), (3, 1, "bad"), (3, 2, None), (4, 1, "boom"), (5, 1, "odd"), (7, 1, "pending"), (8, 1, "title only")]
    old = json.dumps({"title": "chang", "eligibility_rules": 3})
    notices = [(1, sha("one", "two"), old, "APPROVED"), (2, None, old, "APPROVED"), (3, "x", old, "APPROVED"), (4, "x", old, "APPROVED"), (5, "x", old, "APPROVED"), (6, "x", old, "APPROVED"), (7, "x", old, "PENDING")]
    notices += [(8, "x", json.dumps({"title": "none", "eligibility_rules": 10}), "APPROVED"), (8, "x", json.dumps({"title": "title", "eligibility_rules": 10}), "APPROVED")]
    cycle = M.monitoring_cycle(
        spark.createDataFrame(notices, "notification_id long, document_hash string, extraction string, approval_status string"),
        spark.createDataFrame(pages, "notification_id long, page_no int, content string").repartition(4), parse, extract, "title string, eligibility_rules long",
    )
    got = {(x.notification_id, x.change_count): x for x in cycle.collect()}
    assert len(got) == 8 and {x.notification_id for x in got.values()} == {1, 2, 3, 4, 5, 6, 8}
    assert (got[1, None].status, got[1, None].outcome, got[1, None].requires_human_review) == ("SUCCESS", "NO_CHANGE", None)
    assert (got[2, 1].outcome, got[2, 1].current_hash, got[2, 1].requires_eligibility_re_evaluation) == ("CHANGE_DETECTED", sha("changed", ""), True)
    assert (got[8, 1].requires_eligibility_re_evaluation, got[8, 0].requires_human_review) == (False, False)
    errors = {x.notification_id: x.error for x in got.values() if x.status == "FAILED"}
    assert set(errors) == {3, 4, 5, 6} and "extractable" in errors[3] and errors[4] == "RuntimeError: no model" and "eligibility_rules" in errors[5] and "no pages" in errors[6]
    assert all(x.outcome is None and x.current_hash is None for x in got.values() if x.status == "FAILED")
    assert tuple(M.cycle_summary(cycle).first()) == (8, 8, 4, 4)


def files(folder):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_contents_are_stored_once(spark, tmp_path):
    store = f"{tmp_path}/blobs"
    rows = spark.createDataFrame([(1, b"one"), (2, b"one"), (3, b"two"), (4, None), (5, b"")], "id long, body binary")
    assert blobs.stored(spark, store).count() == 0
    assert blobs.store_new(rows, "body", store) == 2
    held = files(store)
    assert blobs.store_new(rows, "body", store) == 0 and files(store) == held
    assert blobs.store_new(spark.createDataFrame([(6, b"two"), (7, b"three")], rows.schema), "body", store) == 1
    assert set(held) < set(files(store))
    got = {bytes(x.content): x.sha256 for x in blobs.stored(spark, store).collect()}
    assert got == {b: hashlib.sha256(b).hexdigest() for b in (b"one", b"two", b"three")}
    paths = {x.id: x.path for x in blobs.with_path(rows, "body", store).collect()}
    assert paths[1] == paths[2] and paths[1].endswith(hashlib.sha256(b"one").hexdigest()) and paths[4] is None and paths[5] is None
