"""Column functions against known values."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.functions import numbers as N
from tessera.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("Indian", "India", True), (" INDIA ", "India", True), ("Bachelor's degree", "Bachelor's", True), ("Nepali", "India", False), ("B.Tech.", "Bachelor's", True), ("12th", "12th / Senior Secondary", True), ("Master's", "Bachelor's", False)],
)
def test_same_text(spark, a, b, same):
    assert one(spark, T.same_text(F.lit(a), F.lit(b))) is same


def test_canonical(spark):
    assert one(spark, T.canonical(F.lit("  Computer   Science "))) == "computer science"
    assert one(spark, T.canonical(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(
    ("text", "days"),
    [
        ("February 6 & 7, 2027", [date(2027, 2, 6), date(2027, 2, 7)]),
        ("6th-9th March 2027", [date(2027, 3, d) for d in (6, 7, 8, 9)]),
        ("Sep 22 – Sep 30, 2026", [date(2026, 9, 22), date(2026, 9, 30)]),
        ("01/02/2027", [date(2027, 2, 1)]),
        ("February 30, 2027", []),
        ("on the 1st of August, 2025", [date(2025, 8, 1)]),
        ("", []),
    ],
)
def test_dates(spark, text, days):
    assert one(spark, D.date_set(F.lit(text))) == days


@pytest.mark.parametrize(
    ("kind", "years", "at", "exclusive", "op", "day"),
    [
        ("maximum", 30, "2026-08-01", False, ">=", date(1995, 8, 2)),
        ("minimum", 18, "2026-08-01", False, "<=", date(2008, 8, 1)),
        ("maximum", 25, "2028-02-29", False, ">=", date(2002, 3, 1)),
        ("maximum", 32, "2025-08-01", True, ">=", date(1993, 8, 2)),
        ("maximum", 32, "2025-08-01", False, ">=", date(1992, 8, 2)),
        ("minimum", 21, "2025-08-01", False, "<=", date(2004, 8, 1)),
    ],
)
def test_birth_bounds(spark, kind, years, at, exclusive, op, day):
    found = one(spark, D.birth_bound(F.lit(kind), F.lit(years), F.lit(at).cast("date"), F.lit(exclusive)))
    assert (found["operator"], found["day"]) == (op, day)


def test_only_one(spark):
    day = lambda x: F.lit(x).cast("date")
    assert one(spark, D.only_one(F.array(day("2026-01-01"), day("2026-01-01")))) == date(2026, 1, 1)
    assert one(spark, D.only_one(F.array(day("2026-01-01"), day("2026-01-02")))) is None


def test_small_texts(spark):
    assert one(spark, T.operator_symbol(F.lit(" At least "))) == ">="
    assert one(spark, T.operator_symbol(F.lit("==="))) == "=" and one(spark, T.operator_symbol(F.lit("not equal"))) == "!="
    for refused in ("about", "more than", "under", "<>", "in", "is", "not less than", "=>"):
        assert one(spark, T.operator_symbol(F.lit(refused))) is None
    assert one(spark, T.attribute_label(F.lit(" DOB "))) == "Date of Birth" and one(spark, T.attribute_label(F.lit("age"))) is None
    assert one(spark, T.digits(F.lit("two of 17 and 2"))) == ["2", "17"]
    assert one(spark, T.country(F.lit("Citizens of the Nepal"))) == "nepal"
    assert one(spark, T.trimmed_list(F.array(F.lit(" a "), F.lit("a"), F.lit(" "), F.lit("b")))) == ["a", "b"]
    assert one(spark, T.is_pdf_address(F.lit(None).cast("string"), F.lit("https://x/A.PDF"))) is True
    assert one(spark, T.model_json(F.lit("no braces"))) is None
    assert one(spark, T.escape_html(F.lit('<a href="x">&</a>'))) == "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"


def test_numbers(spark):
    assert one(spark, N.estimated_tokens(F.lit(None).cast("string"))) == 0
    assert one(spark, N.estimated_tokens(F.lit("four"))) == 2
    assert one(spark, N.clamped(F.lit(99.0))) == 15.0
    assert one(spark, N.shown(F.lit(60.0))) == "60"


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("2026-03-01", date(2026, 3, 1)), ("01/02/2027", date(2027, 2, 1)), ("1.2.2027", date(2027, 2, 1)), ("01-02-2027", date(2027, 2, 1)),
        ("01/02/27", date(2027, 2, 1)), ("01.02.68", date(2068, 2, 1)), ("01-02-69", date(1969, 2, 1)), ("1st March, 2026", date(2026, 3, 1)),
        ("22nd March 2026", date(2026, 3, 22)), ("3 Mar, 2026", date(2026, 3, 3)), ("3 MAR 2026", date(2026, 3, 3)), ("March 3, 2026", date(2026, 3, 3)),
        ("March 3rd 2026", date(2026, 3, 3)), ("Sep 3, 2026", date(2026, 9, 3)), (" Sep 3 2026 ", date(2026, 9, 3)),
        ("2026/03/01", None), ("Sept 3 2026", None), ("31/02/2026", None), ("01/02-2027", None), ("soon", None), ("", None), (None, None),
    ],
)
def test_normal_date(spark, text, day):
    assert one(spark, D.normal_date(F.lit(text).cast("string"))) == day


def test_clean_text(spark):
    rows = spark.createDataFrame([(1, " \ufb01ne\u00a0 x\u200by\t z "), (2, None), (3, "\u2460 \uff21\n\n  b \n"), (4, "")], "i long, t string")
    got = {r.i: (r.c, r.p) for r in rows.select("i", T.clean_text(F.col("t")).alias("c"), T.clean_page(F.col("t")).alias("p")).collect()}
    assert got == {1: ("fine xy z", "fine xy z"), 2: (None, None), 3: ("1 A\n\n b", "1 A\nb"), 4: ("", "")}


def test_years_of_other_centuries(spark):
    text = F.lit("no 12005 of 1995, again 1995, then 2001 and 18999")
    assert one(spark, T.years(text)) == ["2001"]
    assert one(spark, T.years(text, ("19", "20"))) == ["1995", "2001"]


def test_days_are_checked_by_number(spark):
    years = [0, 4, 100, 1900, 2000, 2023, 2024, 9999]
    rows = [(y, m, n) for y in years for m in range(14) for n in range(33)] + [(None, 1, 1), (2024, None, 1), (2024, 1, None)]
    table = spark.createDataFrame(rows, "y int, m int, d int")
    parsed = F.try_to_date(F.format_string("%04d-%02d-%02d", "y", "m", "d"), "yyyy-MM-dd")
    found = table.select(D.day_of(F.col("y"), F.col("m"), F.col("d")).alias("a"), parsed.alias("b"))
    assert found.where("not a <=> b").count() == 0 and found.where("a is null").count() > 100
    plan = spark.createDataFrame([("x",)], "t string").select(D.date_set(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "format_string" not in plan and "yyyy" not in plan
