"""One extraction out of several chunks': scalars that must agree, lists without repeats, rule groups and evidence as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_value(field: Column) -> Column:
    """Over a group: the one value that is not null (null without any)."""
    return F.min(field)


def conflict(name: str, field: Column) -> Column:
    """Over a group: a message when there are different values, else null. No value is guessed."""
    values = F.array_sort(F.collect_set(field))
    return F.when(F.size(values) > 1, F.concat(F.lit(f"Conflicting values found for {name}: "), F.to_json(values)))


def distinct_in_order(order: Column, items: Column) -> Column:
    """Over a group: the items of all rows' arrays in the order of the rows, repeats left out."""
    parts = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce(items, F.array()).alias("x"))))
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: p["x"])))


def aggregate_chunks(chunks: DataFrame, doc: str, order: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """A row for each document: its scalar fields (null where they conflict), its list fields (dates, requirements, rule
    groups, evidence: rows of any type, compared whole; groups of different chunks are never merged), and `conflicts`.
    One grouping; what a caller does with conflicts is its own decision."""
    at = F.col(order)
    found = chunks.groupBy(doc).agg(
        *[one_value(F.col(c)).alias(c) for c in scalars],
        *[conflict(c, F.col(c)).alias(f"_{c}") for c in scalars],
        *[distinct_in_order(at, F.col(c)).alias(c) for c in lists],
    )
    clean = [F.when(F.col(f"_{c}").isNull(), F.col(c)).alias(c) for c in scalars]
    messages = F.array_compact(F.array(*[F.col(f"_{c}") for c in scalars])) if scalars else F.array().cast("array<string>")
    return found.select(doc, *clean, *lists, messages.alias("conflicts"))


def distinct_trees(rows: DataFrame, doc: str, order: str, tree: str) -> DataFrame:
    """Rule trees of a document in order, those whose JSON text is the same as an earlier one's left out."""
    firsts = rows.withColumn("_json", F.to_json(tree)).groupBy(doc, "_json").agg(F.min_by(F.struct(*rows.columns), order).alias("_row"))
    return firsts.select("_row.*")


def by_field(evidence: DataFrame, doc: str, field: str, order: str, *columns: str) -> DataFrame:
    """Evidence grouped by the field that it backs, in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, *columns))), lambda e: F.struct(*[e[c].alias(c) for c in columns]))
    return evidence.groupBy(doc, field).agg(listed.alias("evidence"))


def explicit_limits(limits: DataFrame, doc: str, bound: str, day: str) -> DataFrame:
    """Of every document's stated birth dates: the earliest `from` day and the latest `to` day (the widest limits), and whether
    several different ones are stated, which then hold for some applicants only."""
    low, high = F.when(F.col(bound) == "from", F.col(day)), F.when(F.col(bound) == "to", F.col(day))
    varies = (F.countDistinct(low) > 1) | (F.countDistinct(high) > 1)
    return limits.groupBy(doc).agg(F.min(low).alias("born_from"), F.max(high).alias("born_to"), varies.alias("varies"))


def as_json(df: DataFrame, key: str) -> DataFrame:
    """(key, json): every row's other columns as one JSON text, nulls kept."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"}).alias("json"))


def from_json(rows: DataFrame, key: str, json: str, schema: str) -> DataFrame:
    """The columns again; a text that is no such JSON gives a row of nulls and valid = false."""
    read = F.from_json(F.col(json), f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    return rows.select(key, read.alias("_r")).select(key, "_r.*").withColumn("valid", F.col("_bad").isNull()).drop("_bad")


def report_rows(changes: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """(doc, index, json): a document's changes in order as JSON texts that carry their index."""
    fields = [c for c in changes.columns if c != doc]
    listed = F.array_sort(F.collect_list(F.struct(*order, *[c for c in fields if c not in order])))
    rows = changes.groupBy(doc).agg(listed.alias("_all")).select(doc, F.posexplode("_all").alias("index", "_c"))
    return rows.select(doc, "index", F.to_json(F.struct("index", *[F.col(f"_c.{c}").alias(c) for c in fields])).alias("json"))


def nested(json: Column, path: str, default: str = "") -> Column:
    """A value at a path of a JSON text; the default where a step of the path, or the JSON itself, is missing or null."""
    return F.coalesce(F.get_json_object(json, path), F.lit(default))


def checked_hash(rows: DataFrame, content: str, expected: str) -> DataFrame:
    """rows, after every one's content has the hash that is expected of it; the job fails with the row's hash otherwise."""
    found = F.sha2(F.col(content).cast("binary"), 256)
    held = F.when(found == F.col(expected), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("Document hash mismatch: "), found)).cast("boolean"))
    return rows.where(held)
