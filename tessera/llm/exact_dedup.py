"""Exact dedup: Grace hash deduplication over whole texts.

1. Each input task keeps an open-addressing table of the texts it has seen and emits every distinct text once, with the
   count and the largest doc_id of its copies; when the table's budget is full it is emitted and emptied. So a group of
   copies, however large, crosses the shuffle at most once per filled table.
2. Spark partitions these by a hash of the text. Inside a partition the records are split by further hash bits into spill
   files, again and again, until each file fits an open-addressing table, which compares the complete texts.
3. The groups' results go back to all documents by the text's SHA-256; a group's single row meets its copies in a join
   that adaptive execution can split.

A text is not changed before it is compared. A null text is the empty text. Of equal texts the row with the largest
doc_id stays (a null doc_id is smaller than any); rows equal in doc_id too all count, and all of them carry kept = true
when they hold the largest. Empty tables give no rows. Other columns of the input are not touched.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Bytes that one table may hold before it is emitted (first pass) or split into spill files (second pass): its texts, and
#: ENTRY for the objects and slots of each.
TABLE_BYTES = 48 << 20
ENTRY = 256
FANOUT = 16
GROUPS = "text_sha256 string, keep_id long, group_size long"
LOCAL = "h long, text string, keep_id long, n long"
LOCAL_ARROW = pa.schema([("h", pa.int64()), ("text", pa.large_string()), ("keep_id", pa.int64()), ("n", pa.int64())])


def content_hash(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")


class TextTable:
    """An open-addressing table: linear probing over slots; a slot matches when hash and complete content are equal."""

    def __init__(self) -> None:
        self.slots = np.full(1 << 10, -1, np.int64)
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.keep: list[int | None] = []
        self.count: list[int] = []
        self.bytes = 0

    def _slot(self, h: int, text: bytes) -> int:
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0 and not (self.hashes[k] == h and self.texts[k] == text):
            at = (at + 1) & mask
        return at

    def add(self, h: int, text: bytes, keep: int | None, n: int) -> None:
        at = self._slot(h, text)
        k = self.slots[at]
        if k >= 0:
            self.count[k] += n
            if keep is not None and (self.keep[k] is None or keep > self.keep[k]):
                self.keep[k] = keep
            return
        self.slots[at] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.keep.append(keep)
        self.count.append(n)
        self.bytes += len(text) + ENTRY
        if 2 * len(self.texts) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            mask = len(self.slots) - 1
            for i, hash_ in enumerate(self.hashes):
                at = hash_ & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = i


def signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def local_rows(t: TextTable) -> Iterator[pa.RecordBatch]:
    """The table's rows in batches of a bounded size."""
    lo, size = 0, 0
    for i, text in enumerate(t.texts):
        size += len(text) + 32
        if size > 4 << 20 or i == len(t.texts) - 1:
            hi = i + 1
            texts = pa.array(t.texts[lo:hi], pa.large_binary()).cast(pa.large_string())
            yield pa.RecordBatch.from_arrays([pa.array([signed(h) for h in t.hashes[lo:hi]], pa.int64()), texts, pa.array(t.keep[lo:hi], pa.int64()), pa.array(t.count[lo:hi], pa.int64())], schema=LOCAL_ARROW)
            lo, size = hi, 0


def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass, columns (doc_id, text)."""
    t = TextTable()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = (text.as_py() or "").encode()
            t.add(content_hash(data), data, doc_id, 1)
            if t.bytes > TABLE_BYTES:
                yield from local_rows(t)
                t = TextTable()
    yield from local_rows(t)


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, int | None, int]]:
    for batch in batches:
        cols = [batch.column(i) for i in range(4)]
        for i in range(batch.num_rows):
            yield cols[0][i].as_py() & (2**64 - 1), cols[1][i].as_py().encode(), cols[2][i].as_py(), cols[3][i].as_py()


def grace(rows: Iterator[tuple[int, bytes, int | None, int]], folder: str, level: int, table_bytes: int) -> Iterator[TextTable]:
    """Tables of distinct texts that share none: rows beyond one table's budget go to FANOUT files by the hash's next bits."""
    t = TextTable()
    for row in rows:
        t.add(*row)
        if t.bytes > table_bytes and len(t.texts) > 1 and level < 15:
            break
    else:
        yield t
        return
    paths = [os.path.join(folder, f"{level}-{i}") for i in range(FANOUT)]
    files = [pa.OSFile(p, "wb") for p in paths]
    writers = [pa.ipc.new_stream(f, LOCAL_ARROW) for f in files]
    waiting: list[list[tuple]] = [[] for _ in range(FANOUT)]
    held = [0] * FANOUT

    def flush(i: int) -> None:
        if waiting[i]:
            h, text, keep, n = zip(*waiting[i], strict=True)
            writers[i].write_batch(pa.RecordBatch.from_arrays([pa.array(map(signed, h), pa.int64()), pa.array(text, pa.large_binary()).cast(pa.large_string()), pa.array(keep, pa.int64()), pa.array(n, pa.int64())], schema=LOCAL_ARROW))
            waiting[i], held[i] = [], 0

    def spill(row: tuple) -> None:
        i = (row[0] >> (60 - 4 * level)) & (FANOUT - 1)
        waiting[i].append(row)
        held[i] += len(row[1]) + ENTRY
        if held[i] > 1 << 20:
            flush(i)

    for row in zip(t.hashes, t.texts, t.keep, t.count, strict=True):
        spill(row)
    del t
    for row in rows:
        spill(row)
    for i in range(FANOUT):
        flush(i)
        writers[i].close()
        files[i].close()
    for p in paths:
        sub = tempfile.mkdtemp(dir=folder)
        with pa.OSFile(p, "rb") as f, pa.ipc.open_stream(f) as stream:
            yield from grace(records(stream), sub, level + 1, table_bytes)
        os.remove(p)
        os.rmdir(sub)


def resolve(batches: Iterator[pa.RecordBatch], table_bytes: int = TABLE_BYTES) -> Iterator[pa.RecordBatch]:
    """Second pass: one row for each distinct text of the partition."""
    with tempfile.TemporaryDirectory() as folder:  # spill files of this task alone; they go with it
        for t in grace(records(batches), folder, 0, table_bytes):
            if t.texts:
                digests = [hashlib.sha256(x).hexdigest() for x in t.texts]
                yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(t.keep, pa.int64()), pa.array(t.count, pa.int64())], ["text_sha256", "keep_id", "group_size"])


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row for each distinct text: text_sha256, keep_id, group_size."""
    local = docs.select("doc_id", "text").mapInArrow(collapse, LOCAL)
    return local.repartition("h").mapInArrow(resolve, GROUPS)


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with text_sha256, keep_id, group_size, kept; every row stays (filter on kept to drop the copies)."""
    own = {"text_sha256", "keep_id", "group_size", "kept"}
    kept = [c for c in docs.columns if c.lower() not in own]
    rows = docs.select(*kept, F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"))
    joined = rows.join(exact_groups(docs), "text_sha256")
    return joined.select(*kept, "text_sha256", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
