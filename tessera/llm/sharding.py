"""Sharding: a two-pass external shuffle in DataFrame operations only.

Pass 1 scatters every record by a seeded hash: first to a shard by its doc_id (rendezvous hashing: of all shards the one
with the largest seeded hash of (doc_id, shard) wins, so one more shard takes rows only into itself), then to one of the
shard's memory-sized buckets by doc_id and text, so that rows which share a doc_id spread too. Pass 2 shuffles each bucket
by Fisher-Yates with seeded draws, and a record's slot is its place in its bucket's permutation plus the sizes of the
shard's earlier buckets.

Nulls: a null doc_id is a key like any other (all such rows share a shard, as the law asks), a null text has no bytes.
Ties and repeated rows are put in order by their text's checksum; equal rows are interchangeable, and where many rows are
equal these are numbered and spread over the buckets. Very long texts: a bucket's number of rows is bounded, its texts do
not pass through the permutation. Empty tables give no rows. Columns named like the results (size, text_crc32, shard,
slot) are replaced; all others are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, number_copies, own_names, parallelism, running_sum, table

OWN = {"size", "text_crc32", "shard", "slot"}
#: A bucket holds about so many rows and bytes; so many equal rows need no numbers.
BUCKET_ROWS = 512
BUCKET_BYTES = 8 << 20
EQUAL_ROWS = 1024


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash with the key is largest."""
    tried = [F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return (F.greatest(*tried) if shards > 1 else tried[0])["s"]


def fisher_yates(n: Column, *seeds: Column) -> Column:
    """A permutation of 0..n-1 as an array: the inside-out Fisher-Yates shuffle; draw i is a seeded hash modulo i + 1. Each
    step makes the array anew, so n is to be a bucket's size."""

    def step(acc: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(*seeds, i), (i + 1).cast("bigint")).cast("int")
        swapped = F.array_append(F.concat(F.slice(acc, F.lit(1), j), F.array(i), F.slice(acc, j + 2, i)), F.get(acc, j))
        return F.when(j == i, F.array_append(acc, i)).otherwise(swapped)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), (n - 1).cast("int")), F.array().cast("array<int>"), step))


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = 20) -> DataFrame:
    """docs with size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    kept = [c for c in docs.columns if c.lower() not in OWN]
    copy, bucket, i, n, start, perm = own_names([*kept, *OWN], "copy", "bucket", "i", "n", "start", "perm")
    rows = docs.select(
        *kept,
        (F.length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        rendezvous(F.col("doc_id"), shards, seed).alias("shard"),
    )
    seen = rows.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()  # one row, whatever the input
    buckets = max(1, -(-seen["n"] // (shards * BUCKET_ROWS)), -(-(seen["b"] or 0) // (shards * BUCKET_BYTES)))
    rows = number_copies(rows, ["doc_id", "text_crc32", "size"], EQUAL_ROWS, copy, scratch)
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text_crc32", "size", copy), F.lit(buckets)))

    counts = rows.groupBy("shard", bucket).agg(F.count("*").alias("n")).select("shard", F.col(bucket).alias("bucket"), "n")
    counts = running_sum(scratch.write(counts, "counts"), ["shard"], "bucket", "n", "start").repartition(parallelism(spark), "shard", "bucket")
    perms = counts.select("shard", F.col("bucket").alias(bucket), F.col("start").alias(start), fisher_yates(F.col("n"), F.lit(seed + 2), F.col("shard"), F.col("bucket")).alias(perm))
    inside = Window.partitionBy("shard", bucket).orderBy("doc_id", "text_crc32", "size", copy)
    return (
        rows.withColumn(i, F.row_number().over(inside) - 1)
        .join(scratch.write(perms, "perms"), ["shard", bucket])
        .select(*kept, "size", "text_crc32", "shard", (F.col(start) + F.get(perm, F.col(i))).cast("long").alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 20) -> None:
    """Write the shuffled shards under path, a folder shard=N each, its files in slot order."""
    out = shuffle_into_shards(docs, shards, seed)
    (at,) = own_names(out.columns, "file")
    (
        out.withColumn(at, F.floor(F.col("slot") / (BUCKET_ROWS * 64)))
        .repartition("shard", at)
        .sortWithinPartitions("shard", "slot")
        .drop(at)
        .write.partitionBy("shard")
        .parquet(path)
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shuffle_into_shards(docs)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        rendezvous(F.col("doc_id"), 9, 20).alias("grown_shard"),
    )
