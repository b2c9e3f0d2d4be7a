"""Notices to applicants: who gets one, and none twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def notices(verdicts: DataFrame, active: DataFrame, told: DataFrame, kind: str) -> DataFrame:
    """(student_id, exam_id) of eligible verdicts -> a notice for each active applicant whose dedupe key is not among told."""
    rows = verdicts.join(active.select("student_id"), "student_id", "left_semi")
    rows = rows.withColumn("dedupe_key", F.concat_ws(":", F.lit(kind), "student_id", "exam_id")).dropDuplicates(["dedupe_key"])
    return rows.join(told.select("dedupe_key"), "dedupe_key", "left_anti")


def updates(changes: DataFrame, tracking: DataFrame, message: Column, width: int = 1000) -> DataFrame:
    """A message, cut to width, for every change to everyone that tracks it."""
    return changes.join(tracking.select("student_id"), "student_id", "left_semi").withColumn("message", F.left(message, F.lit(width)))


def deliver(rows: DataFrame, failed: Column, error: Column, has_address: Column) -> DataFrame:
    """Status of each notice after delivery: SENT, FAILED with the error's first 500 characters, SKIPPED without an address."""
    status = F.when(~has_address, "SKIPPED").when(failed, "FAILED").otherwise("SENT")
    return rows.withColumn("email_status", status).withColumn("email_error", F.when(status == "FAILED", F.left(error, F.lit(500))))
