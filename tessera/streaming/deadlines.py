"""Deadline reminders: tiers of days left, one reminder for each applicant, notice and tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import tier


def reminders(notices: DataFrame, status: DataFrame, as_of: str, window: int, excluded: str) -> DataFrame:
    """Notices (student_id, notification_id, deadline) due within the window for all but applicants whose latest status is
    the excluded one; an applicant without a status is reminded."""
    today = F.lit(as_of).cast("date")
    due = notices.where(F.col("deadline").between(today, F.date_add(today, window)))
    rows = due.join(status, "student_id", "left").where(~F.col("status").eqNullSafe(F.lit(excluded)))
    left = F.date_diff("deadline", today)
    rows = rows.withColumn("days_left", left.cast("long")).withColumn("tier", tier(left))
    return rows.withColumn("dedupe_key", F.concat_ws(":", F.lit("deadline"), "student_id", "notification_id", "tier"))
