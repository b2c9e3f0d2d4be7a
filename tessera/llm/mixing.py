"""Mixing sources to target weights: weighted fair queueing in DataFrame operations only.

Every source's documents stand in a seeded random order, and the source may go through it `repeats` times. The queue has an
entry for each document and pass; its virtual finish time is the number of its source's words up to and including it,
divided by the source's weight, its virtual start that of the words before it. All entries are range-sorted by finish time.
Along this order two sums run, the weights and the words of the sources whose last entry has gone by; with them every entry
says how many words are served by its finish: those of the finished sources, and the others' weights times the time. Where
that passes the total budget (all words) the queue is cut: what has finished by then is taken whole, what is being served
(one document of each source) in part, so that every source takes its target to the word. `mixed_queue` gives the cut queue,
globally range-sorted by finish time; `mix` gives each document what its entries take together.

Targets follow from the source totals alone (sort the sources by the time they run out, then one running sum). The running
word count of a source is a prefix sum in levels, over ranges of the shuffle order sized by the number of rows, so no task
holds a whole source. Sizes are counted once, into a written table. The queue is a written table of times without documents;
its running sums go over ranges, and inside the one range in which the cut lies.

Nulls: a null text has no words and is never taken; a null source is a source of its own, last in order. Rows are ordered
by a hash of doc_id and text, so null and repeated doc_ids spread; rows equal in both are rows of their own, numbered where
there are many. Very long texts are counted whole and taken in part only where the queue is cut. Empty tables give no
rows. Columns named like the results (size, source_size, target, taken) are replaced, all others kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, number_copies, own_names, parallelism, running_sum, table

OWN = {"size", "source_size", "target", "taken"}
#: Rows of a source's range, on average, and of equal rows that need no numbers.
RANGE_ROWS = 512


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weigh(sources: DataFrame, repeats: int = 3) -> DataFrame:
    """sources (source, source_size) -> with w (1, 2, 3, repeating by code point, null last) and target.

    With V the virtual time, a source gets min(repeats * size, w * V). Sources sorted by the time they run out,
    repeats * size / w: V lies after the last source that runs out before the budget is spent.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("w", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(repeats))).withColumn("ends", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    up_to = Window.orderBy("ends", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    solved = (
        ranked.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("spent", F.coalesce(F.sum("cap").over(up_to), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(up_to), F.lit(0.0)))
        .withColumn("v", (F.col("total") - F.col("spent")) / F.col("w_left"))  # were this source the first not to run out
    )
    solved = solved.withColumn("fits", F.col("v") <= F.col("ends"))
    solved = solved.withColumn("served", F.min(F.when(F.col("fits"), F.struct("ends", "v"))).over(everything)["v"])
    return solved.select(*sources.columns, "w", F.least("cap", F.col("w") * F.coalesce("served", F.lit(float("inf")))).alias("target"))


def served(row: Column, k: int) -> tuple[Column, Column, Column, Column]:
    """Of a document's entry in pass k: virtual start and finish, the virtual time of the cut, and the words taken."""
    start = row["before"] + F.lit(k) * row["source_size"]
    cut = F.floor(row["target"] + F.lit(1e-6))  # words of the source by the cut; divided by the weight, the cut's virtual time
    taken = F.greatest(F.lit(0), F.least(row["size"], cut - start)).cast("long")
    return start / row["w"], (start + row["size"]) / row["w"], cut / row["w"], taken


def queued(docs: DataFrame, seed: int, repeats: int, name: str, keep: list[str] | None = None) -> DataFrame:
    """docs (without OWN; of its columns those in keep, if given) and a column `name`: a struct of size, source_size, target, w, before (words of the source before it), src (the source's name)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    kept = [c for c in docs.columns if c.lower() not in OWN and (keep is None or c in keep)]
    size, text, src, copy, place, at, inside = own_names([*docs.columns, name], "size_", "text_md5", "src", "copy", "place", "range", "inside")
    needed = [c for c in docs.columns if c in {*kept, "doc_id", "source"}]
    rows = docs.select(
        *needed,
        words(F.col("text")).alias(size),
        F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias(text),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias(src),
    )
    rows = scratch.write(rows, "sizes")
    rows = number_copies(rows, [src, "doc_id", text], RANGE_ROWS, copy, scratch)
    key = F.concat_ws(":", F.lit(seed), F.col("doc_id"), text, F.when(F.col(copy) > 0, F.col(copy)))
    rows = rows.withColumn(place, F.md5(key.cast("binary")))
    ranges = max(1, rows.count() // RANGE_ROWS)
    bits = min(60, 4 * -(-(ranges.bit_length()) // 4))  # the place's first digits, whole ones
    rows = rows.withColumn(at, F.conv(F.substring(place, 1, bits // 4), 16, 10).cast("long") if bits else F.lit(0).cast("long"))

    sums = rows.groupBy(src, at).agg(F.min("source").alias("source"), F.sum(size).alias("words"))
    sums = scratch.write(running_sum(sums.withColumnsRenamed({src: "src", at: "at"}), ["src"], "at", "words", "before"), "ranges")
    sources = weigh(sums.groupBy("src").agg(F.min("source").alias("source"), F.sum("words").alias("source_size")), repeats)
    sources = scratch.write(sources.select("src", "source_size", "w", "target"), "sources")
    starts = scratch.write(sums.select("src", "at", "before").join(sources, "src"), "starts")
    parts = F.struct("before", "source_size", "w", "target")
    starts = starts.select(F.col("src").alias(src), F.col("at").alias(at), parts.alias(name))
    within = Window.partitionBy(src, at).orderBy(place, F.col("doc_id").asc_nulls_first(), text, copy).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(inside, F.coalesce(F.sum(size).over(within), F.lit(0))).join(starts, [src, at])
    of = F.col(name)
    full = F.struct(F.col(size).alias("size"), of["source_size"].alias("source_size"), of["target"].alias("target"), of["w"].alias("w"), (of["before"] + F.col(inside)).alias("before"), F.col(src).alias("src"))
    return rows.select(*kept, full.alias(name))


def entries(rows: DataFrame, name: str, repeats: int) -> DataFrame:
    """(finish, w, spent, gone) of every document with words and pass: spent and gone are a source's weight and words at its
    last entry, else 0."""
    of = F.col(name)
    each = []
    for k in range(repeats):
        start = of["before"] + F.lit(k) * of["source_size"]
        last = start + of["size"] == F.lit(repeats) * of["source_size"]
        none = F.lit(0.0)
        each.append(F.struct(((start + of["size"]) / of["w"]).alias("finish"), F.when(last, of["w"]).otherwise(none).alias("spent"), F.when(last, (start + of["size"]).cast("double")).otherwise(none).alias("gone")))
    return rows.where(of["size"] > 0).select(F.inline(F.array(*each)))


def cut_time(queue: DataFrame, weight: float, budget: float, scratch: Scratch) -> float:
    """The virtual time at which the queue has served the budget; infinite if it never does. weight: of all sources."""
    ranged = queue.repartitionByRange(parallelism(queue.sparkSession), "finish").sortWithinPartitions("finish")
    held = scratch.write(ranged.withColumn("range", F.spark_partition_id()), "queue")
    sums = held.groupBy("range").agg(F.max("finish").alias("t"), F.sum("spent").alias("spent"), F.sum("gone").alias("gone"))
    up_to = Window.orderBy("range")
    run = sums.select("range", "t", F.sum("spent").over(up_to.rowsBetween(Window.unboundedPreceding, 0)).alias("w"), F.sum("gone").over(up_to.rowsBetween(Window.unboundedPreceding, 0)).alias("words"), "spent", "gone")
    reached = run.where(F.col("words") + (F.lit(weight) - F.col("w")) * F.col("t") >= F.lit(budget - 1e-6))
    first = reached.orderBy("range").select("range", (F.col("w") - F.col("spent")).alias("w"), (F.col("words") - F.col("gone")).alias("words")).first()
    if first is None:
        return float("inf")
    before = Window.orderBy("finish").rowsBetween(Window.unboundedPreceding, -1)
    inside = held.where(F.col("range") == first["range"])  # one range: a task's share of the sorted queue
    left = F.lit(weight - first["w"]) - F.coalesce(F.sum("spent").over(before), F.lit(0.0))
    words = F.lit(first["words"]) + F.coalesce(F.sum("gone").over(before), F.lit(0.0))
    inside = inside.select("finish", left.alias("left"), words.alias("words")).where(F.col("words") + F.col("left") * F.col("finish") >= F.lit(budget - 1e-6))
    cut = inside.orderBy("finish").first()
    return (budget - cut["words"]) / cut["left"] if cut["left"] > 0 else float("inf")


def mix(docs: DataFrame, seed: int = 9, repeats: int = 3, keep: list[str] | None = None) -> DataFrame:
    """docs (of its columns those in keep, if given) with size, source_size, target, taken (words the mix takes, repeats
    counted)."""
    (name,) = own_names(docs.columns, "queued")
    scratch = Scratch(docs.sparkSession, "mixing-queue")
    rows = queued(docs, seed, repeats, name, keep)
    of = F.col(name)
    sources = rows.groupBy(of["src"].alias("src")).agg(F.first(of["w"]).alias("w"), F.first(of["source_size"]).alias("n"))
    total = sources.agg(F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("w"))), F.lit(0.0)).alias("w"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n")).first()
    time = cut_time(entries(rows, name, repeats), total["w"], total["n"], scratch)
    # Words of the source that are served by the cut.
    served_by = F.floor(F.least(F.lit(float(repeats)) * of["source_size"], of["w"] * F.lit(time)) + F.lit(1e-6))
    part = lambda k: F.greatest(F.lit(0), F.least(of["size"], served_by - of["before"] - F.lit(k) * of["source_size"]))
    taken = F.when(of["size"] > 0, sum((part(k) for k in range(1, repeats)), part(0))).otherwise(0)
    kept = [c for c in rows.columns if c != name]
    return rows.select(*kept, of["size"].alias("size"), of["source_size"].alias("source_size"), of["target"].alias("target"), taken.cast("long").alias("taken"))


def mixed_queue(docs: DataFrame, seed: int = 9, repeats: int = 3) -> DataFrame:
    """The mix itself: an entry for every document and pass that the cut queue takes for the most part, with virtual_finish,
    globally sorted by it (a range shuffle)."""
    (name, entry) = own_names([*docs.columns, "virtual_finish"], "queued", "entry")
    rows = queued(docs, seed, repeats, name)
    kept = [c for c in rows.columns if c != name and c.lower() != "virtual_finish"]
    passes = []
    for k in range(repeats):
        start, finish, cut, _ = served(F.col(name), k)
        middle = (start + finish) / 2
        passes.append(F.when((F.col(name)["size"] > 0) & (middle <= cut), F.struct(finish.alias("finish"))))
    queue = rows.select(*kept, F.explode(F.array_compact(F.array(*passes))).alias(entry))
    return queue.select(*kept, F.col(entry)["finish"].alias("virtual_finish")).orderBy("virtual_finish")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")
