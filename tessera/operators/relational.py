"""Relational building blocks: catalogue, latest-per-key, counts, paging, set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_any(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of left that have a partner: a semi join instead of a join and distinct."""
    return left.join(right.select(F.col(right_key).alias("_k")), F.col(left_key) == F.col("_k"), "left_semi")


def without_any(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    return left.join(right.select(F.col(right_key).alias("_k")), F.col(left_key) == F.col("_k"), "left_anti")


def contains_ci(term: str, *columns: str) -> Column:
    """A case-insensitive substring of any column; % and _ in the term keep their LIKE meaning."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{term.strip()}%"), F.lit(False))
    return hit


def latest(df: DataFrame, key: str, order: Column, tie: str) -> DataFrame:
    """The whole latest row of each key: order descending with null last, then the tie descending. One grouped maximum, no sort."""
    rank = F.struct(order.isNotNull().alias("known"), order.alias("at"), F.col(tie).alias("tie"))
    best = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), rank).alias("_row"))
    return best.select("_row.*")


def versions(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def last_then(df: DataFrame, key: str, order: str, keep: Column) -> DataFrame:
    """The newest row of each key, only where it satisfies keep (rank, then filter)."""
    newest = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("_row"))
    return newest.select("_row.*").where(keep)


def last_of(df: DataFrame, key: str, order: str, keep: Column) -> DataFrame:
    """The newest row of each key among those that satisfy keep (filter, then rank)."""
    newest = df.where(keep).groupBy(key).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("_row"))
    return newest.select("_row.*")


def flips(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Every row with the value before it in its key's history and whether it changed; the first row has not."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("previous", F.lag(value).over(w)).withColumn("changed", F.coalesce(F.col("previous") != F.col(value), F.lit(False)))


def count_by(flags: dict[str, Column]) -> list[Column]:
    return [F.count_if(c).cast("long").alias(name) for name, c in flags.items()]


def page(df: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    """A page of a totally ordered result; limit is held to 1..500."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(500, max(1, limit)))


def dedupe_insert(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of new to append: none whose key exists, the first of equal keys; a null key never equals another."""
    keyed, free = new.where(F.col(key).isNotNull()), new.where(F.col(key).isNull())
    fresh = keyed.join(existing.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min_by(F.struct(*new.columns), F.col(order)).alias("_row")).select("_row.*")
    return first.unionByName(free)


def unpivot_timeline(df: DataFrame, ident: str, dates: dict[str, str], since: str) -> DataFrame:
    """One row for each non-null date column of a row, on or after a day."""
    parts = [F.struct(F.lit(kind).alias("kind"), F.col(c).cast("date").alias("day")) for kind, c in dates.items()]
    return df.select(ident, F.inline(F.array(*parts))).where(F.col("day") >= F.lit(since).cast("date"))


def key_difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """ADDED, REMOVED and COMMON keys."""
    both = old.select(F.col(key).alias("o")).distinct().join(new.select(F.col(key).alias("n")).distinct(), F.col("o") == F.col("n"), "full")
    kind = F.when(F.col("o").isNull(), "ADDED").when(F.col("n").isNull(), "REMOVED").otherwise("COMMON")
    return both.select(F.coalesce("o", "n").alias(key), kind.alias("change"))
