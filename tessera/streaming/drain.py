"""Running a stream to its end and reading what it wrote; replaying a table as a stream of files in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load, shared_folder
from .sinks import batches, run_to_end, write_batch

#: Rows of a stream's file, at least.
FILE_ROWS = 100


def event_stream(spark: SparkSession, folder: str, steps: int, events: DataFrame | None = None) -> DataFrame:
    """The events table (or another one with ts) as a stream of `steps` micro-batches, each later than the one before.

    A step's rows are dealt evenly to as many files as the session has shuffle partitions, the same number in each step, so
    that a micro-batch is read in parallel and takes one step's files, all of them."""
    path = shared_folder(spark, "events")
    rows = (load(spark, folder, "events") if events is None else events).withColumn("ts", F.col("ts").cast("timestamp"))
    span = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))  # one row
    share = (F.unix_micros("ts") - F.unix_micros("a")) / (F.unix_micros("b") - F.unix_micros("a") + 1)
    parts = rows.crossJoin(F.broadcast(span)).withColumn("step", F.floor(share * steps).cast("int")).drop("a", "b")
    least = parts.groupBy("step").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]  # one row
    files = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), (least or 0) // FILE_ROWS))
    for k in range(steps):  # one write each, so that the files' times are in order
        parts.where(F.col("step") == k).drop("step").repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def drained(stream: DataFrame, mode: str, key: list[str] | None = None, value: str | None = None) -> DataFrame:
    """All that the stream gives until its source has no more, as a table: the rows of an append stream, or of an update
    stream each key's value of the last micro-batch that changed it. A replayed micro-batch replaces its rows."""
    spark = stream.sparkSession
    out, state = shared_folder(spark, "stream"), shared_folder(spark, "state")
    run_to_end(stream, mode, state, lambda batch, number: write_batch(batch, number, out))
    rows = batches(spark, out)
    if rows is None:
        rows = spark.createDataFrame([], stream.schema).withColumn("batch_no", F.lit(0))
    if key is None:
        return rows.drop("batch_no")
    return rows.groupBy(*key).agg(F.max_by(value, "batch_no").alias(value))
