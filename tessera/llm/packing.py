"""Packing: all documents' tokens end to end, cut into sequences of a fixed length.

Pass 1 turns texts into token ids and writes them down as chunks: the ids of up to `chunk_tokens` consecutive tokens of a
task's documents, with the number of the task's partition, the chunk's place among the partition's tokens and the pieces of
documents in it. Pass 2 sums up the partitions' totals, one number for each, to the global offset of every chunk. Each chunk
then cuts itself at the multiples of the sequence length: what fills a sequence is one, what stands over at the chunk's two
ends becomes boundary records, and only these meet, by the number of their sequence, to be joined to whole ones. All
sequences but the very last are full.

A chunk is a row of a written table, so its offset and its cuts are the same however often they are worked out, and no task
needs to see where another one ended. Its row is wide, so row groups are small: a task writes and reads some hundred chunks at
a time, however many there are in a file. Order is that of the input's partitions and rows.

Ids are those of the vocabulary's own library. Latin-1 texts without special strings, for which the two splitters' patterns
agree character by character, are encoded by the faster library over the same vocabulary as ranks.

A document is its text's ids and one end id. Nulls and empty texts have the end id alone; a null key is a key like any other
and repeated rows are rows of their own. Very long texts run through as many sequences as they need. Empty tables give no
sequences. The input's columns keep their names inside the pieces, beside start, length, doc_tokens and offset; key columns
named like these are refused.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from .common import Scratch, running_sum, table

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
LENGTH, END_ID = 2048, 1
CHUNK_TOKENS = 1 << 15
#: Bytes of a row group of chunks as written.
ROW_GROUP = 8 << 20
#: Bytes of an id.
WIDE = 4
OWN = ("start", "length", "doc_tokens", "offset")


class Encoder:
    """Texts to ids as the library for the vocabulary gives them."""

    def __init__(self, vocabulary: str, ranks: str | None) -> None:
        self.library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            with open(public_tokenizers.path(ranks), "rb") as f:
                table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def plain(self, text: str) -> bool:
        """Whether both splitters are known to see the same classes of characters in it: Latin-1, whose classes no Unicode
        version has changed, and no special string."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not any(s in text for s in self.specials)

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is not None and self.plain(text):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


_encoders: dict[tuple[str, str | None], Encoder] = {}


def encoder_of(vocabulary: str, ranks: str | None) -> Encoder:
    if (vocabulary, ranks) not in _encoders:
        _encoders[vocabulary, ranks] = Encoder(vocabulary, ranks)
    return _encoders[vocabulary, ranks]


class Chunk:
    """The chunk that a task is filling."""

    def __init__(self, at: int, most: int) -> None:
        self.at, self.most, self.size, self.ids, self.pieces = at, most, 0, [], []

    def add(self, key: dict, ids: np.ndarray, start: int) -> int:
        """Take as many of the document's ids from start on as fit; how many."""
        taken = min(len(ids) - start, self.most - self.size)
        self.ids.append(ids[start : start + taken])
        self.pieces.append(key | {"start": start, "length": taken, "doc_tokens": len(ids), "offset": self.size})
        self.size += taken
        return taken

    def batch(self, part: int, piece: pa.DataType) -> pa.RecordBatch:
        ids = np.concatenate(self.ids).tobytes()
        columns = {"part": pa.array([part], pa.int32()), "at": pa.array([self.at], pa.int64()), "size": pa.array([self.size], pa.int64())}
        columns |= {"ids": pa.array([ids], pa.binary()), "pieces": pa.array([self.pieces], pa.list_(piece))}
        return pa.RecordBatch.from_arrays([*columns.values()], [*columns])


def encode_chunks(vocabulary: str, ranks: str | None, end_id: int, keys: list[str], piece: pa.DataType, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, chunk = encoder_of(vocabulary, ranks), TaskContext.get().partitionId(), Chunk(0, most)
        end = np.array([end_id], "<u4")
        for batch in batches:
            named = batch.select(keys).to_pylist() if keys else [{}] * batch.num_rows
            for key, text in zip(named, batch.column("text"), strict=True):
                ids, start = np.concatenate([encoder.ids(text.as_py() or ""), end]), 0
                while start < len(ids):
                    start += chunk.add(key, ids, start)
                    if chunk.size == most:
                        yield chunk.batch(part, piece)
                        chunk = Chunk(chunk.at + most, most)
        if chunk.size:
            yield chunk.batch(part, piece)

    return run


def piece_type(docs: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([*docs.select(*keys).schema.fields, *[T.StructField(c, T.LongType()) for c in OWN]])


def clipped(pieces: Column, lo: Column, hi: Column, keys: list[str]) -> Column:
    """The parts of a chunk's pieces between its tokens lo and hi, with offsets from lo on."""

    def part(p: Column) -> Column:
        first = F.greatest(p["offset"], lo)
        last = F.least(p["offset"] + p["length"], hi)
        start = p["start"] + first - p["offset"]
        return F.struct(*[p[k].alias(k) for k in keys], start.alias("start"), (last - first).alias("length"), p["doc_tokens"].alias("doc_tokens"), (first - lo).alias("offset"))

    return F.transform(F.filter(pieces, lambda p: (p["offset"] < hi) & (p["offset"] + p["length"] > lo)), part)


def joined(records: Column, keys: list[str]) -> Column:
    """The pieces of a sequence's boundary records, in order; what goes on from one record to the next is one piece again."""

    def moved(p: Column, by: Column, more: Column) -> Column:
        return F.struct(*[p[k].alias(k) for k in keys], p["start"].alias("start"), (p["length"] + more).alias("length"), p["doc_tokens"].alias("doc_tokens"), (p["offset"] + by).alias("offset"))

    def step(before: Column, record: Column) -> Column:
        own = F.transform(record["pieces"], lambda p: moved(p, record["offset"], F.lit(0)))
        last, first = F.element_at(before, -1), F.get(own, F.lit(0))
        whole = F.array_append(F.slice(before, F.lit(1), F.size(before) - 1), moved(last, F.lit(0), first["length"]))
        going_on = (F.size(before) > 0) & (first["start"] > 0)
        return F.when(going_on, F.concat(whole, F.slice(own, F.lit(2), F.size(own)))).otherwise(F.concat(before, own))

    none = F.slice(F.get(records, F.lit(0))["pieces"], F.lit(1), F.lit(0))
    return F.aggregate(records, none, step)


def packed_sequences(
    docs: DataFrame, keys: list[str], length: int = LENGTH, end_id: int = END_ID, vocabulary: str = VOCABULARY, ranks: str | None = RANKS, chunk_tokens: int = CHUNK_TOKENS
) -> DataFrame:
    """The sequences of docs' texts: sequence_id from 0, size, ids (little-endian, 32 bits each) and pieces, each with the
    document's keys, start (its ids before the piece), length, doc_tokens and offset in the sequence."""
    if {k.lower() for k in keys} & set(OWN):
        raise ValueError(f"keys must not be named {', '.join(OWN)}")
    piece = piece_type(docs, keys)
    scratch = Scratch(docs.sparkSession, "packing")
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("at", T.LongType()),
            T.StructField("size", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("pieces", T.ArrayType(piece)),
        ]
    )
    encode = encode_chunks(vocabulary, ranks, end_id, keys, to_arrow_type(piece), chunk_tokens)
    chunks = scratch.write(docs.select(*dict.fromkeys([*keys, "text"])).mapInArrow(encode, schema), "chunks", compression="zstd", row_group=ROW_GROUP)

    totals = chunks.groupBy("part").agg(F.sum("size").alias("total")).withColumn("every", F.lit(0))
    first = scratch.write(running_sum(totals, ["every"], "part", "total", "first").select("part", "first"), "first")
    # One row for each task of pass 1: far less than Spark itself keeps for a task.
    placed = chunks.join(F.broadcast(first), "part").withColumn("from", F.col("first") + F.col("at")).withColumn("to", F.col("from") + F.col("size"))

    number = F.sequence(F.floor(F.col("from") / length), F.floor((F.col("to") - 1) / length))
    cuts = placed.withColumn("sequence_id", F.explode(number))
    cuts = cuts.withColumn("lo", F.greatest("from", F.col("sequence_id") * length)).withColumn("hi", F.least("to", (F.col("sequence_id") + 1) * length))
    lo, hi = F.col("lo") - F.col("from"), F.col("hi") - F.col("from")
    records = cuts.select(
        "sequence_id",
        (F.col("lo") - F.col("sequence_id") * length).alias("offset"),
        (hi - lo).alias("size"),
        F.substring("ids", (lo * WIDE + 1).cast("int"), ((hi - lo) * WIDE).cast("int")).alias("ids"),
        clipped(F.col("pieces"), lo, hi, keys).alias("pieces"),
    )
    whole = records.where(F.col("size") == length).drop("offset")
    # A record for each chunk that has tokens of the sequence: `length` at most.
    met = records.where(F.col("size") < length).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "size", "ids", "pieces"))).alias("records"))
    ids = F.aggregate("records", F.lit(b""), lambda a, r: F.concat(a, r["ids"]))
    size = F.aggregate("records", F.lit(0).cast("long"), lambda a, r: a + r["size"])
    bound = met.select("sequence_id", size.alias("size"), ids.alias("ids"), joined(F.col("records"), keys).alias("pieces"))
    return whole.union(bound)


def padding(size: Column, length: int = LENGTH) -> Column:
    """Pad ids that a sequence of this size gets: up to `length`, none at a power of two."""
    return F.when((size == length) | (size.bitwiseAND(size - 1) == 0), F.lit(0).cast("long")).otherwise(length - size)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = packed_sequences(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    pieces = sequences.select("sequence_id", "ids", F.col("size").alias("tokens"), F.explode("pieces").alias("p"))
    own = F.substring("ids", (F.col("p.offset") * WIDE + 1).cast("int"), (F.col("p.length") * WIDE).cast("int"))
    return pieces.select(
        "p.doc_id",
        "p.start",
        "p.length",
        F.crc32(own).alias("ids_crc32"),
        "p.doc_tokens",
        "sequence_id",
        "p.offset",
        padding(F.col("tokens")).alias("padding"),
    )
