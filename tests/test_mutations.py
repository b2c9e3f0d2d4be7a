"""Numbering new rows at a size where the input has many partitions, and wide rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import mutations as M
from tessera.operators import rules as R


def test_get_or_create_keeps_every_row(spark, tmp_path):
    n, old = 400_000, 1000
    wide = F.concat_ws("-", F.sha2(F.col("id").cast("string"), 512), F.col("id"))
    wanted = spark.range(0, n, 1, 12).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), wide.alias("payload"))
    known = spark.range(0, n, n // old, 4).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), (F.floor(F.col("id") / (n // old)) + 1).alias("ident"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        M.get_or_create(known, wanted, "key", "ident").write.parquet(f"file://{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    out = spark.read.parquet(f"file://{tmp_path}/out")
    got = out.agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.countDistinct("ident").alias("ids"), F.min("ident").alias("low"), F.max("ident").alias("high"), F.count_if("created").alias("made"), F.countDistinct("payload").alias("payloads")).first()
    assert tuple(got) == (n, n, n, 1, n, n - old, n)
    new = out.where("created").select("key", "ident")
    assert new.agg(F.min("ident")).first()[0] == old + 1
    ends = new.agg(F.min_by("ident", "key"), F.max_by("ident", "key")).first()
    assert tuple(ends) == (old + 1, n)  # in key order


def test_lost_groups_are_refused(spark):
    groups = spark.createDataFrame([(1, 1, None, 1, "AND"), (1, 2, 7, 1, "OR")], "notice long, group_id long, parent_group_id long, group_number int, logical_operator string")
    rules = spark.createDataFrame([(1, 1, "CGPA", ">", "1", "numeric")], "rule_id long, group_id long, attribute string, operator string, value string, data_type string")
    pairs = spark.createDataFrame([(1, 1, {"cgpa": "2"}, [])], "student_id long, notice long, facts map<string,string>, work array<string>")
    with pytest.raises(ValueError, match="missing parent group: 2"):
        R.evaluate(pairs, groups, rules)
