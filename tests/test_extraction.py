"""The extraction as a whole, with a stub in the model's place; and what plans must not hold."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tessera.operators.extraction import extract
from tessera.plans.catalogue import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_extract(spark):
    text = "# NOTICE\nabout nothing at all\n# DATES\nApplications open on 1 August 2026 and close on 30 September 2026.\n"
    docs = spark.createDataFrame([(1, text), (2, "FILLER\nno days here")], "doc_id long, text string")
    seen = {}

    def stub(context):
        seen["rows"] = {(r.doc_id, r.section) for r in context.collect()}
        rows = [
            (1, 1, "30 September 2026", "1 August 2026", "applications open on 1 August 2026"),
            (1, 2, "5 May 2031", None, "the exam is on 5 May 2031"),
            (1, 3, "soon", None, "close on 30 September 2026"),
        ]
        return spark.createDataFrame(rows, "doc_id long, fact_id long, start string, end string, quote string")

    got = {r.fact_id: r for r in extract(docs, stub, {"applications": 2.0, "open": 1.0}).collect()}
    assert (1, "DATES") in seen["rows"]
    assert (got[1].start_day, got[1].end_day, got[1].exact, got[1].issues) == (date(2026, 8, 1), date(2026, 9, 30), True, ["dates-were-swapped"])
    assert got[2].issues == ["date-not-in-document", "quote-not-found"] and got[3].issues == ["unreadable-date"]


@pytest.mark.parametrize("name", ["catalog_semi", "latest_per_key", "two_hop_join", "diff_rows", "impact_rollup", "bm25_scores", "chunks_fixed", "date_mentions", "quote_locate", "rules_eval"])
def test_no_python_in_the_plan(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow", "CartesianProduct"))


def test_latest_per_key_does_not_sort_its_input(spark):
    plan = QUERIES["latest_per_key"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max_by" in plan


def test_only_needed_columns_are_read(spark):
    plan = QUERIES["delete_cascade_survivors"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan


def test_facts_are_asked_for_once(spark):
    """The facts are a written table: what stands for a model is not worked out again for each use of its facts."""

    def stub(context):
        rows = context.select("doc_id", F.lit(1).cast("long").alias("fact_id"), F.lit("1 May 2027").alias("start"), F.lit(None).cast("string").alias("end"), F.lit("closes on 1 May 2027").alias("quote"), F.rand().alias("_x"))
        return rows.where("_x >= 0").drop("_x")

    docs = spark.createDataFrame([(1, "# Dates\nThe portal closes on 1 May 2027.\n# More\nclosing 2 May 2027"), (2, "# Dates\nIt closes on 3 May 2027.")], "doc_id long, text string")
    found = extract(docs, stub, {"closes": 2.0})
    assert "rand(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((x.doc_id, x.grounded, x.passage is not None) for x in found.collect()) == [(1, True, True), (2, False, False)]
