"""From whole documents to grounded dates: passages, a pack within a token budget, injected facts, evidence, compiled dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_set
from ..sources.tables import materialise
from .compiling import compile_dates
from .retrieval import bm25_scores, locate_quotes, pack, section_passages


def extract(docs: DataFrame, facts_of: Callable[[DataFrame], DataFrame], terms: dict[str, float], budget: int = 2000) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fact_id, start_day, end_day, swapped, grounded, unreadable, passage (where the quote
    stands), exact, issues.

    docs may have a page each (a column page); passages follow their headings and tables. facts_of gets the packed context (doc_id, passage, section, text) and gives facts (doc_id, fact_id, start, end, quote);
    it stands for a model, is called once and never row by row. A fact without a place for its quote stays, with an issue.

    Passages and facts are written tables; a document's dates are read once, not for each of its facts."""
    pages = docs if "page" in docs.columns else docs.withColumn("page", F.lit(1))
    passages = materialise(section_passages(pages, "doc_id", "page", "text"), "passages")
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))
    docs = docs.select("doc_id", F.array_join(F.transform("pages", lambda p: p["text"]), "\n").alias("text")).select("doc_id", date_set(F.col("text")).alias("_days"))
    scores = bm25_scores(passages, "doc_id", "passage", "text", terms, "section")
    scored = passages.join(scores, ["doc_id", "passage"], "left").fillna(0.0, ["score"])
    chosen = pack(scored, "doc_id", "passage", "section", "text", budget)
    context = passages.join(chosen.select("doc_id", "passage"), ["doc_id", "passage"], "left_semi")
    facts = materialise(facts_of(context), "facts")
    places = locate_quotes(facts, passages.select("doc_id", "passage", "text"), "fact_id", "quote", "doc_id", "passage", "text")
    dated = compile_dates(facts.join(docs, "doc_id"), "doc_id", "start", "end", known_days=F.col("_days"))
    found = dated.join(places.select("doc_id", "fact_id", "passage", "exact"), ["doc_id", "fact_id"], "left")
    issues = F.array_compact(
        F.array(
            F.when(F.col("unreadable"), "unreadable-date"),
            F.when(~F.col("unreadable") & ~F.col("grounded"), "date-not-in-document"),
            F.when(F.col("passage").isNull(), "quote-not-found"),
            F.when(F.col("swapped"), "dates-were-swapped"),
        )
    )
    return found.select("doc_id", "fact_id", "start_day", "end_day", "swapped", "grounded", "unreadable", "passage", "exact", issues.alias("issues"))


def manual_issues(minimum: Column, maximum: Column, not_available: Column, rules: Column) -> Column:
    """What is wrong with eligibility that an administrator enters by hand, besides the rules' own issues: `rules` is how many
    there are."""
    checks = [
        F.when(minimum > maximum, "minimum-age-above-maximum"),
        F.when(not_available & (rules > 0), "rules-though-not-available"),
        F.when(~not_available & (rules == 0), "no-rules"),
    ]
    return F.array_compact(F.array(*checks))


def is_usable(name: Column, exam_dates: Column, closes: Column, rule_groups: Column) -> Column:
    """An extraction worth a review: a name, and a date, an end of applications or a rule group (their numbers)."""
    return (F.coalesce(name, F.lit("")) != "") & ((exam_dates > 0) | closes.isNotNull() | (rule_groups > 0))


def summary(name: Column, body: Column, opens: Column, closes: Column, dates: Column, rules: Column, blocking: Column) -> Column:
    """A plain summary of an extraction; dates: array of (start, end), all days as texts."""
    by = F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(" conducted by "), body)).otherwise("")
    spans = F.transform(dates, lambda r: F.when(r["start"] == r["end"], r["start"]).otherwise(F.concat(r["start"], F.lit(" to "), r["end"])))
    parts = [
        F.concat(F.coalesce(F.nullif(name, F.lit("")), F.lit("Exam")), by, F.lit(".")),
        F.when(opens.isNotNull() | closes.isNotNull(), F.concat(F.lit("Applications: "), F.coalesce(opens, F.lit("start date not announced")), F.lit(" to "), F.coalesce(closes, F.lit("unknown")), F.lit("."))),
        F.when(F.size(dates) > 0, F.concat(F.lit("Exam: "), F.array_join(spans, ", "), F.lit("."))),
        F.format_string("%d eligibility rule(s) extracted.", rules),
        F.when(blocking > 0, F.format_string("%d issue(s) need review before approval.", blocking)),
    ]
    return F.array_join(F.array_compact(F.array(*parts)), " ")
