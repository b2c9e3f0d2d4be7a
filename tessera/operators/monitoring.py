"""A monitoring cycle over all approved notices: parse, compare, extract, find what changed. A failure is its notice's own: it
travels in an error column, and the stages after it leave the row alone."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialise
from .callables import called
from .changes import diff, flatten_json, impact_rollup


def parsed_documents(pages: DataFrame, key: str, page: str, content: str, parse: Callable[[str], str]) -> DataFrame:
    """(key, text, pages, pages_with_text, pages_failed, error) of documents given as pages: a page that can't be parsed
    (parse raises, or its content is null) is an empty page; a document without any text on its pages fails. Pages are joined
    by a form feed, in order; white space is no text."""
    text = called(pages, content, lambda x: {"text": parse(x)}, "text string", keep=[key, page])
    rows = text.select(key, page, F.coalesce("value.text", F.lit("")).alias("text"), F.col("error").isNotNull().alias("failed"))
    placed = F.array_sort(F.collect_list(F.struct(page, "text")))
    out = rows.groupBy(key).agg(
        F.array_join(F.transform(placed, lambda x: x["text"]), "\f").alias("text"),
        F.count("*").alias("pages"),
        F.count_if(F.col("text").rlike(r"\S")).alias("pages_with_text"),
        F.count_if("failed").alias("pages_failed"),
    )
    return out.withColumn("error", F.when(F.col("pages_with_text") == 0, "The document contains no extractable text."))


def monitoring_cycle(notices: DataFrame, pages: DataFrame, parse: Callable[[str], str], extract: Callable[[str], Any], result: str) -> DataFrame:
    """One row for every approved notice (notification_id, document_hash, extraction: JSON, approval_status): status SUCCESS
    or FAILED, error, and of the result what may be shown: outcome (NO_CHANGE, CHANGE_DETECTED), changed, previous_hash,
    current_hash, change_count, requires_human_review, requires_eligibility_re_evaluation. No text or extraction is in it.

    pages: notification_id, page_no, content. parse and extract are injected; extract's answers must fit `result` (DDL). A
    notice without pages, one without text, one whose extraction fails or does not fit fails; all others go on. Only changed
    documents are extracted. A repeated notification_id is a notice for each row."""
    approved = notices.where("approval_status = 'APPROVED'").select("notification_id", "document_hash", "extraction")
    watched = pages.join(approved.select("notification_id").distinct(), "notification_id", "left_semi")
    documents = parsed_documents(watched, "notification_id", "page_no", "content", parse).withColumn("current_hash", F.sha2("text", 256))
    rows = approved.join(documents.select("notification_id", "text", "current_hash", "error"), "notification_id", "left")
    rows = rows.withColumn("error", F.when(F.col("current_hash").isNull(), "The document contains no pages.").otherwise(F.col("error")))
    changed = F.col("error").isNull() & ~F.col("document_hash").eqNullSafe(F.col("current_hash"))
    rows = rows.withColumn("changed", changed).withColumn("_row", F.monotonically_increasing_id())
    rows = materialise(rows, "watched")

    asked = called(rows.where("changed"), "text", extract, result, keep=["_row", "extraction"])
    asked = materialise(asked.withColumn("now", F.to_json("value")).select("_row", "extraction", "now", "error"), "extracted")
    good = asked.where("error is null")
    changes = diff(flatten_json(good, "_row", "extraction"), flatten_json(good, "_row", "now"), "_row")
    rolled = impact_rollup(changes, "_row").select("_row", "changes", "re_evaluate")

    out = rows.join(asked.select("_row", F.col("error").alias("_late")), "_row", "left").join(rolled, "_row", "left")
    error = F.coalesce("error", "_late")
    fine = lambda c: F.when(error.isNull(), c)
    counted = F.coalesce("changes", F.lit(0).cast("long"))
    return out.select(
        "notification_id",
        F.when(error.isNull(), "SUCCESS").otherwise("FAILED").alias("status"),
        error.alias("error"),
        fine(F.when(F.col("changed"), "CHANGE_DETECTED").otherwise("NO_CHANGE")).alias("outcome"),
        fine(F.col("changed")).alias("changed"),
        fine(F.col("document_hash")).alias("previous_hash"),
        fine(F.col("current_hash")).alias("current_hash"),
        fine(F.when(F.col("changed"), counted)).alias("change_count"),
        fine(F.when(F.col("changed"), counted > 0)).alias("requires_human_review"),
        fine(F.when(F.col("changed"), F.coalesce("re_evaluate", F.lit(False)))).alias("requires_eligibility_re_evaluation"),
    )


def cycle_summary(cycle: DataFrame) -> DataFrame:
    """One row: notifications_found, notifications_processed, successful, failed."""
    n = F.count("*")
    return cycle.agg(n.alias("notifications_found"), n.alias("notifications_processed"), F.count_if(F.col("status") == "SUCCESS").alias("successful"), F.count_if(F.col("status") == "FAILED").alias("failed"))
