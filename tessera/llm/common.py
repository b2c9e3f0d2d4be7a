"""What several operators of this subpackage share: the shared folder, reading tables, hashing words of Arrow text."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that numpy works on at a time.
BLOCK = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local one only where the session names none and runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> Iterator[None]:
    """Inside, tasks hand their Python workers batches of at most about `most` bytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """The tables that one run writes to the shared folder: each cuts the lineage and survives a lost executor. What drop()
    has not deleted before goes when the session's process ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.held: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, name: str, compression: str | None = None, row_group: int | None = None) -> DataFrame:
        """Write df once and read it back. row_group: bytes of a row group as written (100 rows at least), for tables of wide
        rows: a task holds one when it writes, and reads up to 4,096 rows of one at a time."""
        path = f"{self.folder}/{name}-{len(self.held)}"
        options = {"parquet.block.size": row_group} if row_group else {}
        with bounded_batches(self.spark):
            df.write.options(**options).parquet(path, compression=compression)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(at)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this run that nothing reads any more."""
        for df, path in self.held:
            if any(df is t for t in tables):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and survives a lost executor."""
    return Scratch(df.sparkSession, name).write(df, name)


def own_names(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores after it as keep it apart from the taken ones."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def number_copies(rows: DataFrame, key: list[str], most: int, name: str, scratch: Scratch) -> DataFrame:
    """rows with a column `name`: 0, or different numbers from 0 on for the rows of a key that more than `most` rows share.

    These are numbered inside their input partitions, held in a written table, so no task sees all rows of a key.
    """
    c, part, n, start, *other = own_names([*rows.columns, name], "c", "part", "n", "start", *[f"{k}_of" for k in key], "part_of")
    hot = rows.groupBy(*key).agg(F.count("*").alias(c)).where(F.col(c) > most).drop(c)
    hot = scratch.write(hot, "hot")
    if hot.isEmpty():
        return rows.withColumn(name, F.lit(0).cast("long"))
    held = scratch.write(rows.withColumn(part, F.spark_partition_id()), "held")
    same = reduce(and_, [held[k].eqNullSafe(hot[k]) for k in key])
    cold = held.join(hot, same, "left_anti")
    own = held.join(hot, same, "left_semi")
    counts = own.groupBy(*key, part).agg(F.count("*").alias(n))
    before = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*key, part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    counts = counts.select(*[F.col(k).alias(o) for k, o in zip([*key, part], other, strict=True)], start)
    own = own.withColumn(n, F.row_number().over(Window.partitionBy(*key, part).orderBy(part)) - 1)
    own = own.join(counts, reduce(and_, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip([*key, part], other, strict=True)])).withColumn(name, (F.col(start) + F.col(n)).cast("long"))
    return cold.select(*rows.columns, F.lit(0).cast("long").alias(name)).union(own.select(*rows.columns, name))


def running_sum(rows: DataFrame, by: list[str], order: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """rows (by, order: an integer, value) with `name`, the sum of value over the smaller orders of the same by.

    In two levels, so that a window holds at most `width` different orders, or one row for each `width` of them.
    """
    group, total, first = own_names([*rows.columns, name], "group", "total", "first")
    held = rows.withColumn(group, F.floor(F.col(order) / width))
    inside = Window.partitionBy(*by, group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy(*by, group).agg(F.sum(value).alias(total))
    earlier = Window.partitionBy(*by).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, group, F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(first))
    held = held.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return held.join(sums, [*by, group]).withColumn(name, F.col(name) + F.col(first)).drop(group, first)


def bucket_of(key: Column, mod: int) -> Column:
    """crc32 of the key written as text, modulo mod (a null key counts as the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % mod


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- Arrow text as numpy


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column as one byte array, and the n + 1 offsets of the rows; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def lower_ascii() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_ascii()
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words, so that all bits of a polynomial hash spread."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _tables or len(_tables["p"]) < n:
        m = max(n, BLOCK + 64)
        one = np.ones(1, np.uint64)
        with np.errstate(over="ignore"):
            _tables["p"] = np.concatenate([one, np.cumprod(np.full(m - 1, _P))])
            _tables["q"] = np.concatenate([one, np.cumprod(np.full(m - 1, _PINV))])
    return _tables["p"][:n], _tables["q"][:n]


def span_hashes(block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of block[start:end], the same wherever the bytes stand."""
    p, q = _powers(len(block) + 1)
    total = np.zeros(len(block) + 1, np.uint64)
    np.cumsum(_BYTE[block] * p[:-1], out=total[1:])
    return mix64((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def word_spans(block: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space bytes; breaks: positions where a text begins."""
    full = ~IS_SPACE[block]
    first = np.zeros(len(block) + 1, bool)
    first[breaks] = True
    start = full.copy()
    start[1:] &= ~full[:-1] | first[1:-1]
    end = full.copy()
    end[:-1] &= ~full[1:] | first[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def blocks(raw: np.ndarray, off: np.ndarray, size: int = BLOCK):
    """Cut the bytes of many texts into blocks of about size bytes that never split a word; yields (lo, hi, breaks in the block)."""
    lo, n = 0, len(raw)
    while lo < n:
        want = size
        while True:
            hi = min(n, lo + want)
            if hi < n:
                gap = np.flatnonzero(IS_SPACE[raw[lo:hi]])
                last = off[np.searchsorted(off, hi, "right") - 1]
                hi_ = max(lo + int(gap[-1]) + 1 if len(gap) else lo, int(last))
                if hi_ <= lo:
                    want *= 2
                    continue
                hi = hi_
            break
        inside = off[np.searchsorted(off, lo) : np.searchsorted(off, hi)] - lo
        yield lo, hi, inside
        lo = hi


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased (A-Z only) words in order, and the n + 1 offsets of the texts among them."""
    parts, at = [], []
    for lo, hi, breaks in blocks(raw, off):
        block = LOWER[raw[lo:hi]]
        s, e = word_spans(block, breaks)
        parts.append(span_hashes(block, s, e))
        at.append(s + lo)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    starts = np.concatenate(at)
    return np.concatenate(parts), np.searchsorted(starts, off)


def row_slices(off: np.ndarray, size: int):
    """Ranges of rows whose texts have about size bytes together, one row at least."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, min(n, hi)
        lo = min(n, hi)


def framed(raw: np.ndarray, off: np.ndarray, before: int, after: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts with before and after fill bytes around each; and the n + 1 offsets of the framed texts."""
    n = len(off) - 1
    out = np.full(len(raw) + (before + after) * n, fill, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(n, dtype=np.int64) * (before + after) + before, np.diff(off))] = raw
    return out, off + np.arange(n + 1) * (before + after)


def bounded_sample(rows: DataFrame, label: str, key: list[str], total: int, seed: int) -> pa.Table:
    """At most `total` rows, the same number of each label at the most, chosen by a seeded hash of key; a label with fewer
    keeps all (rows equal in key and label count once). Of more than `total` labels the commonest are taken."""
    counted = rows.groupBy(label).agg(F.count("*").alias("rows_of")).orderBy(F.desc("rows_of"), label).limit(total).collect()
    if not counted:
        return rows.limit(0).toArrow()
    most = max(1, total // len(counted))
    schema = T.StructType([rows.schema[label], T.StructField("share_of", T.DoubleType())])
    shares = rows.sparkSession.createDataFrame([(r[label], 1.5 * most / r["rows_of"]) for r in counted], schema)  # `total` rows at most
    place = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) / F.lit(1 << 30)
    near = rows.join(F.broadcast(shares), label).withColumn("place_of", place).where("place_of < share_of").dropDuplicates([label, *key])
    order = ["place_of", label, *key]
    some = near.orderBy(*order).limit(2 * total).toArrow().sort_by([(c, "ascending") for c in [label, *order]])
    first, at = np.zeros(some.num_rows, np.int64), {}
    for i, x in enumerate(some.column(label).to_pylist()):
        first[i] = at[x] = at.get(x, -1) + 1
    return some.filter(pa.array(first < most)).select(rows.columns)
