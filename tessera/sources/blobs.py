"""A store of contents by their SHA-256: each content is written once, whatever its number of names and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _there(spark: SparkSession, folder: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored(spark: SparkSession, store: str) -> DataFrame:
    """(sha256, content, prefix) of all that the store holds; prefix, the hash's first two digits, is the folder."""
    schema = "sha256 string, content binary, prefix string"
    return spark.read.schema(schema).parquet(store) if _there(spark, store) else spark.createDataFrame([], schema)


def store_new(rows: DataFrame, content: str, store: str) -> int:
    """Write the contents that the store does not hold, one of equal ones, in folders by their hash; how many. Null and empty
    contents are not stored. Hashes alone are compared with the store's, so no stored content is read; a run that finds
    nothing new writes no file, and one that was broken off is made whole by the next."""
    spark = rows.sparkSession
    own = rows.select(F.col(content).cast("binary").alias("content")).where("length(content) > 0")
    named = own.withColumn("sha256", F.sha2("content", 256)).join(stored(spark, store).select("sha256"), "sha256", "left_anti")
    fresh = named.groupBy("sha256").agg(F.first("content").alias("content")).withColumn("prefix", F.left("sha256", F.lit(2)))
    before = stored(spark, store).count()
    if fresh.isEmpty():
        return 0
    fresh.write.mode("append").partitionBy("prefix").parquet(store)
    return stored(spark, store).count() - before


def with_path(rows: DataFrame, content: str, store: str) -> DataFrame:
    """rows with sha256 and path, where the store has their content; null for null and empty contents."""
    sha = F.when(F.length(content) > 0, F.sha2(F.col(content).cast("binary"), 256))
    return rows.withColumn("sha256", sha).withColumn("path", F.concat(F.lit(f"{store.rstrip('/')}/prefix="), F.left("sha256", F.lit(2)), F.lit("/"), "sha256"))
