"""Writes as pure functions from old rows and requests to new rows; a table format with MERGE can apply the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise


def get_or_create(known: DataFrame, wanted: DataFrame, key: str, ident: str) -> DataFrame:
    """Every wanted row with its id: the known one, or the next numbers in key order, with created saying which.

    The new rows are numbered by range: their range partition is written down with them, because a partition's number may
    not be asked for twice (two plans over the same rows may cut them differently). Then counts by partition, and a place
    inside each, so no task sorts them all. Equal keys get different numbers.
    """
    top = known.agg(F.coalesce(F.max(ident), F.lit(0)).alias("_top"))
    both = wanted.join(known.select(key, ident), key, "left")
    fresh = both.where(F.col(ident).isNull()).drop(ident)
    placed = materialise(fresh.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "placed")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_from", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = placed.join(F.broadcast(before), "_part").withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(key)))  # before: a row for each partition
    made = numbered.crossJoin(F.broadcast(top)).select(*wanted.columns, (F.col("_top") + F.col("_from") + F.col("_i")).cast("long").alias(ident), F.lit(True).alias("created"))  # top: one row
    return both.where(F.col(ident).isNotNull()).select(*wanted.columns, F.col(ident).cast("long").alias(ident), F.lit(False).alias("created")).unionByName(made)


def insert_checked(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose parent exists, the refused ones)"""
    have = parents.select(F.col(parent_key).alias("_k"))
    return rows.join(have, F.col(key) == F.col("_k"), "left_semi"), rows.join(have, F.col(key) == F.col("_k"), "left_anti")


def insert_unique_active(existing: DataFrame, rows: DataFrame, keys: list[str], active: Column, order: str) -> DataFrame:
    """Rows of keys without an active row; of several new ones the first by order."""
    held = existing.where(active).select(*keys).distinct()
    fresh = rows.join(held, keys, "left_anti")
    return fresh.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("_row")).select("_row.*")


def overlay(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """rows with the patch's columns where it has the key: soft deletes, marks, edits in place."""
    changed = [c for c in patch.columns if c != key]
    named = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in changed], F.lit(True).alias("_hit"))
    pick = lambda c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    return rows.join(named, key, "left").select(*[pick(c) if c in changed else F.col(c) for c in rows.columns])


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All children of the parents in new are replaced by those in new."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def purge(rows: DataFrame, at: str, now: str, grace: str) -> DataFrame:
    """Without rows that expired longer than grace ago; a null time never expires."""
    limit = F.expr(f"timestamp_ntz'{now}' - interval {grace}")
    return rows.where(F.col(at).isNull() | (F.col(at) >= limit))


def approval_guard(rows: DataFrame, key: str, ident: str, pending: Column, blocking: Column | None = None) -> DataFrame:
    """rows with verdict: approvable only when pending, the latest of its key, and without a blocking issue."""
    newest = F.col(ident) == F.max(ident).over(Window.partitionBy(key))
    case = F.when(~F.coalesce(pending, F.lit(False)), "not pending").when(~newest, "not the latest")
    if blocking is not None:
        case = case.when(blocking, "blocking issue")
    return rows.withColumn("verdict", case.otherwise("ok"))


def audit(old: DataFrame, new: DataFrame, key: str, entity: str, width: int = 8000) -> DataFrame:
    """A row for each key whose columns differ, with both versions as JSON cut to width."""
    fields = [c for c in old.columns if c != key]
    a = old.select(key, F.to_json(F.struct(*fields)).alias("old_value"))
    b = new.select(key, F.to_json(F.struct(*fields)).alias("new_value"))
    rows = a.join(b, key, "full").where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    return rows.select(key, F.lit(entity).alias("entity_type"), F.left("old_value", F.lit(width)).alias("old_value"), F.left("new_value", F.lit(width)).alias("new_value"))


def send_gate(sends: DataFrame, key: str, at: str, now: str, cooldown: int, per_hour: int) -> DataFrame:
    """For every key: seconds to wait until the next send (0 when ready) and whether the hourly allowance is used up."""
    moment = F.lit(now).cast("timestamp_ntz")
    since = F.timestamp_diff("SECOND", F.col(at), moment)
    last, hour = F.min(since).alias("_since"), F.count_if(since < 3600).alias("_hour")
    wait = F.when(F.col("_since") >= cooldown, 0).otherwise(cooldown - F.col("_since")).cast("long")
    return sends.where(F.col(at) <= moment).groupBy(key).agg(last, hour).select(key, wait.alias("wait"), (F.col("_hour") >= per_hour).alias("used_up"))


def code_state(sent: Column, attempts: Column, now: Column, minutes: int = 10, most: int = 5, days: int = 1) -> Column:
    """What a code that was sent is still good for: open, locked after `most` wrong attempts, expired after minutes, purged
    after days."""
    age = F.unix_micros(now) - F.unix_micros(sent)
    return F.when(age > days * 86_400_000_000, "purged").when(age > minutes * 60_000_000, "expired").when(attempts >= most, "locked").otherwise("open")
