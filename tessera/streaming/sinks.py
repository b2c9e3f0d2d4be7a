"""Writing a stream's micro-batches so that a replayed one changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, folder: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def batches(spark: SparkSession, store: str, schema: str | None = None) -> DataFrame | None:
    """All that is stored, with the number of its batch (batch_no); None before the first batch."""
    if not exists(spark, store):
        return None
    reader = spark.read if schema is None else spark.read.schema(f"{schema}, batch_no long")
    return reader.parquet(store)


def write_batch(batch: DataFrame, number: int, store: str) -> None:
    """A micro-batch has a folder of its own by its number; a replay overwrites it."""
    batch.write.mode("overwrite").parquet(f"{store}/batch_no={number}")


def append_once(batch: DataFrame, number: int, store: str, key: str) -> None:
    """The rows of a batch whose key no earlier batch has stored, one of each key. What a batch writes depends on its rows and
    the earlier batches alone, so a replay after a failure, half written or not, gives the same. Of equal keys the least row
    stays; rows without a key are never the same."""
    spark = batch.sparkSession
    named = batch.where(F.col(key).isNotNull())
    first = named.groupBy(key).agg(F.min(F.struct(*batch.columns)).alias("_row")).select("_row.*")
    stored = batches(spark, store)
    if stored is not None:
        first = first.join(stored.where(F.col("batch_no") < number).select(key), key, "left_anti").select(*batch.columns)
    write_batch(first.unionByName(batch.where(F.col(key).isNull())), number, store)


def run_to_end(stream: DataFrame, mode: str, state: str, write: Callable[[DataFrame, int], None]) -> None:
    """Let a stream run until its source has no more; state is its checkpoint folder, from which a later run goes on."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
