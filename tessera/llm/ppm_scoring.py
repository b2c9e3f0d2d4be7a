"""LM scoring: prediction by partial matching over bytes, and the smoothed unigram base beside it.

The trie holds, for every context of up to four bytes, the counts of the bytes that follow it in the training texts
(lower-cased, A-Z only; byte 0xFF, which UTF-8 never uses, stands before the first and after the last byte). Coding a byte
starts at the longest known context. There, escape method C gives a symbol n / (N + D) and the escape D / (N + D), N the
count and D the number of different symbols; after an escape the symbols of the longer context are excluded from the
shorter one's counts. Because the symbols known in a context are known in its suffixes too, the excluded mass is one number
for each context, found when the model is built. Below order 0 the symbols left are equally likely.

Counting covers all training texts: tasks count in numpy and Spark sums by key; N, D and the excluded mass of every context
come from all counts. The tables sent to all tasks have proven sizes: the code lengths of the longest contexts' symbols with
at least 2^-22 of all counts (so at most 2^22), and the words with at least 2^-20 of all tokens (at most 2^20). Both tables
only save work: a text's other symbols are handed on as different keys with how often they occur, and get their code length
by joins with the counts of every order; the counts of rarer words come by a join on the word's 64-bit hash. Model options
that hold at every size: ORDER, NODE_SHARE, WORD_SHARE.

Nulls and empty texts: no words, one end token; the text's code is its end symbol. Repeated rows are rows of their own.
A null doc_id counts as the empty text for the fold. Without training texts every symbol has 1/256 and every token 0
counts of 0 (base_score is then 0). Empty tables give no rows. Extra columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, bucket_of, materialise, row_slices, table, text_bytes, word_hashes

ORDER = 4
NODE_SHARE = 2.0**-22
WORD_SHARE = 2.0**-20
CHUNK = 1 << 19
SLICE = 1 << 20
WORD, BYTES = 0, 1
EDGE = 0xFF
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class HashIndex:
    """Positions of 64-bit keys by open addressing in numpy arrays; -1 for a key that is not there."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, EMPTY, np.uint64)
        self.at = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot] == EMPTY
            self.keys[slot[free]] = keys[left[free]]
            self.at[slot[free]] = left[free]
            lost = self.at[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.at[slot]
        other = np.flatnonzero((self.keys[slot] != keys) & (found >= 0))
        slot = slot[other]
        while len(other):
            slot = (slot + 1) & self.mask
            now = self.at[slot]
            found[other] = now
            on = (self.keys[slot] != keys[other]) & (now >= 0)
            other, slot = other[on], slot[on]
        return found


def framed(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts with ORDER edge bytes before and one after each; the place after each text's end symbol."""
    n = len(off) - 1
    length = np.diff(off)
    out = np.full(len(raw) + (ORDER + 1) * n, EDGE, np.uint8)
    shift = np.repeat(np.arange(n, dtype=np.int64) * (ORDER + 1) + ORDER, length)
    out[np.arange(len(raw)) + shift] = LOWER[raw]
    return out, off[1:] + np.arange(1, n + 1) * (ORDER + 1)


def keys_of(framed_: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, key) in chunks: key is the ORDER bytes of context and the symbol; the places that are padding are left out."""
    pad = np.zeros(len(framed_) + 1, bool)
    for k in range(ORDER):
        pad[np.concatenate([[0], ends[:-1]]) + k] = True
    for lo in range(ORDER, len(framed_), CHUNK):
        hi = min(len(framed_), lo + CHUNK)
        key = np.zeros(hi - lo, np.uint64)
        for k in range(ORDER, -1, -1):
            key = (key << np.uint64(8)) | framed_[lo - k : hi - k]
        real = ~pad[lo:hi]
        yield np.flatnonzero(real) + lo, key[real]


class Counter:
    """Sums counts by key; handed on when it holds many different keys."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.parts.append((k, c))
        self.held += len(k)
        if self.held > 1 << 21:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([p[0] for p in self.parts] or [np.zeros(0, np.uint64)])
        counts = np.concatenate([p[1] for p in self.parts] or [np.zeros(0, np.int64)])
        k, at = np.unique(keys, return_inverse=True)
        self.parts = [(k, np.bincount(at, counts, len(k)).astype(np.int64))]
        self.held = len(k)


COUNTS = "kind int, key long, n long"


def count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words (by hash) and of contexts with their symbols."""
    own = {WORD: Counter(), BYTES: Counter()}

    def out(least: int) -> Iterator[pa.RecordBatch]:
        for kind, counter in own.items():
            if counter.held > least:
                counter.merge()
                if counter.held > least:
                    for lo in range(0, counter.held, 1 << 18):
                        k, c = (x[lo : lo + (1 << 18)] for x in counter.parts[0])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.astype(np.int64)), pa.array(c)], ["kind", "key", "n"])
                    own[kind] = Counter()

    for batch in batches:
        raw, off = text_bytes(batch.column("text"))
        for lo, hi in row_slices(off, SLICE):
            part = off[lo : hi + 1]
            bytes_ = raw[part[0] : part[-1]]
            own[WORD].add(word_hashes(bytes_, part - part[0])[0])
            for _, key in keys_of(*framed(bytes_, part - part[0])):
                own[BYTES].add(key)
        yield from out(1 << 20)
    yield from out(0)


def low(column: str, n: int) -> Column:
    """The last n bytes of a key."""
    return F.col(column).bitwiseAND(F.lit((1 << (8 * n)) - 1))


def small(table_: DataFrame, n: int) -> DataFrame:
    """A table with one row for each n bytes, broadcast where there can't be more than 2^16 rows."""
    return F.broadcast(table_) if n <= 2 else table_


def count_orders(nodes: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order j: (key, n) of all contexts of j bytes with their symbols; (ctx, total, d, n_left, d_left) of all
    contexts, where n_left and d_left are what is left of its suffix's total and d when the symbols of ctx are excluded."""
    levels = [nodes]
    for j in range(ORDER, 0, -1):
        levels.insert(0, materialise(levels[0].groupBy(low("key", j).alias("key")).agg(F.sum("n").alias("n")), "order"))
    contexts: list[DataFrame] = []
    for j, level in enumerate(levels):
        rows = level.select("key", "n", F.shiftright("key", 8).alias("ctx"), low("key", j).alias("low"))
        if j:
            rows = rows.join(small(levels[j - 1].select(F.col("key").alias("low"), F.col("n").alias("n_low")), j), "low")
        else:
            rows = rows.withColumn("n_low", F.lit(0))
        own = rows.groupBy("ctx").agg(F.sum("n").alias("total"), F.count("*").alias("d"), F.sum("n_low").alias("taken"))
        if j:
            suffix = contexts[j - 1].select(F.col("ctx").alias("low"), F.col("total").alias("total_low"), F.col("d").alias("d_low"))
            own = own.withColumn("low", low("ctx", j - 1)).join(small(suffix, j - 1), "low")
            own = own.select("ctx", "total", "d", (F.col("total_low") - F.col("taken")).alias("n_left"), (F.col("d_low") - F.col("d")).alias("d_left"))
        else:
            own = own.select("ctx", "total", "d", F.lit(0).cast("long").alias("n_left"), F.lit(0).cast("long").alias("d_left"))
        contexts.append(materialise(own, "contexts"))
    return list(zip(levels, contexts, strict=True))


def code_lengths(keys: DataFrame, orders: list[tuple[DataFrame, DataFrame]], rest: float) -> DataFrame:
    """(key, code): log10 probability of every different key's symbol after its context under escape method C with exclusion."""
    found = keys
    for j, (level, contexts) in enumerate(orders):
        found = found.withColumn("at", low("key", j + 1)).join(small(level.select(F.col("key").alias("at"), F.col("n").alias(f"n{j}")), j + 1), "at", "left").drop("at")
        known = contexts.select(F.col("ctx").alias("at"), *[F.col(c).alias(f"{c}{j}") for c in ("total", "d", "n_left", "d_left")])
        found = found.withColumn("at", F.shiftright(low("key", j + 1), 8)).join(small(known, j), "at", "left").drop("at")
    first = after = F.lit(rest)  # first: no longer context is known; after: escaped from the next longer one
    for j in range(len(orders)):
        n, total, d = (F.col(f"{c}{j}") for c in ("n", "total", "d"))
        first = F.when(total.isNull(), first).when(n.isNotNull(), F.log10(n / (total + d))).otherwise(F.log10(d / (total + d)) + after)
        if j + 1 < len(orders):
            n_left, d_left = F.col(f"n_left{j + 1}"), F.col(f"d_left{j + 1}")
            escape = F.when(d_left > 0, F.log10(d_left / (n_left + d_left))).otherwise(0.0)
            after = F.when(n.isNotNull(), F.log10(n) - F.log10(n_left + d_left)).otherwise(escape + after)
    return found.select("key", first.alias("code"))


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>, cold array<long>, times array<long>"
_model: dict = {}


def distinct_keys(of: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys of each of n texts, text after text: the n + 1 offsets of the texts, keys, times."""
    order = np.lexsort((keys, of))
    of, keys = of[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])
    first = np.flatnonzero(new)
    return np.searchsorted(of[first], np.arange(n + 1)), keys[first], np.diff(np.append(first, len(keys)))


def score_texts(model):
    """A row for each text; base and known cover the words of the broadcast table, rare lists the hashes of the others.
    score covers the symbols of the broadcast table, cold lists the keys of the others and times how often each occurs."""
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), *[(c, pa.list_(pa.int64())) for c in ("rare", "cold", "times")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _model.get("id") != id(model.value):
            keys, _, words, counts = model.value
            _model.update(id=id(model.value), held=model.value, keys=HashIndex(keys), words=HashIndex(words), log=np.log10(counts + 0.1) if len(counts) else np.zeros(1))
        nodes, words, logs = _model["keys"], _model["words"], _model["log"]
        codes = model.value[1]
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            raw, off = text_bytes(batch.column("text"))
            for lo, hi in row_slices(off, SLICE):
                part, n = off[lo : hi + 1], hi - lo
                bytes_ = raw[part[0] : part[-1]]
                h, at = word_hashes(bytes_, part - part[0])
                doc = np.repeat(np.arange(n), np.diff(at))
                found = words.find(h)
                hot = found >= 0
                base = np.bincount(doc[hot], logs[found[hot]], n)
                known = np.bincount(doc[hot], minlength=n)
                rare_at = np.concatenate([[0], np.cumsum(np.bincount(doc[~hot], minlength=n))])
                text, ends = framed(bytes_, part - part[0])
                score = np.zeros(n)
                missed = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
                for place, key in keys_of(text, ends):
                    of, at_ = np.searchsorted(ends, place, "right"), nodes.find(key)
                    hit = at_ >= 0
                    score += np.bincount(of[hit], codes[at_[hit]], n)
                    missed.append((of[~hit], key[~hit]))
                cold_at, cold, times = distinct_keys(*map(np.concatenate, zip(*missed, strict=True)), n)
                own = batch.slice(lo, n)
                rare = pa.ListArray.from_arrays(pa.array(rare_at.astype(np.int32)), pa.array(h[~hot].astype(np.int64)))
                cold_, times_ = (pa.ListArray.from_arrays(pa.array(cold_at.astype(np.int32)), pa.array(x.astype(np.int64))) for x in (cold, times))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + n)), own.column("doc_id").cast(pa.int64()), own.column("held_out"), pa.array(np.diff(at) + 1), pa.array(known), pa.array(base), pa.array(score), rare, cold_, times_], schema=schema)
                rid += n

    return run


def lm_scores(docs: DataFrame, folds: int = 10, held: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from the documents outside the held fold."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", (bucket_of(F.col("doc_id"), folds) == held).alias("held_out"))
    train = docs.where(~F.col("held_out"))
    counts = materialise(train.select("text").mapInArrow(count_texts, COUNTS).groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words, nodes = counts.where(f"kind = {WORD}"), counts.where(f"kind = {BYTES}").select("key", "n")
    seen = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    texts = train.count()
    n_all, distinct = seen["n"] + texts, seen["v"] + (texts > 0)

    orders = count_orders(nodes)
    rest = -float(np.log10(256 - orders[0][0].count()))
    level, contexts = orders[ORDER]
    often = level.where(F.col("n") >= NODE_SHARE * total).withColumn("ctx", F.shiftright("key", 8)).join(contexts, "ctx")
    often = often.select("key", F.log10(F.col("n") / (F.col("total") + F.col("d"))).alias("code")).toArrow()  # at most 1 / NODE_SHARE rows
    hot = words.where(F.col("n") >= WORD_SHARE * n_all).select("key", "n").toArrow()  # at most 1 / WORD_SHARE rows
    model = (often.column(0).to_numpy().astype(np.uint64), often.column(1).to_numpy().astype(np.float64), hot.column(0).to_numpy().astype(np.uint64), hot.column(1).to_numpy().astype(np.float64))
    scored = materialise(docs.mapInArrow(score_texts(spark.sparkContext.broadcast(model)), SCORED), "scored")

    rare = scored.select("rid", F.explode("rare").alias("key")).groupBy("rid", "key").agg(F.count("*").alias("tf"))
    seldom = words.where(F.col("n") < WORD_SHARE * n_all).select("key", "n")
    rare = rare.join(seldom, "key", "left").groupBy("rid").agg(F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("tf"))).alias("also"))
    cold = scored.select("rid", F.explode(F.arrays_zip("cold", "times")).alias("c")).select("rid", F.col("c.cold").alias("key"), F.col("c.times").alias("times"))
    codes = materialise(code_lengths(materialise(cold.select("key").distinct(), "cold"), orders, rest), "codes")
    cold = cold.join(codes, "key").groupBy("rid").agg(F.sum(F.col("times") * F.col("code")).alias("escaped"))
    out = scored.drop("rare", "cold", "times").join(rare, "rid", "left").join(cold, "rid", "left")
    end, scale = (float(np.log10(texts + 0.1)), float(np.log10(n_all + 0.1 * (distinct + 1))))
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(scale)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0)) + F.lit(int(texts > 0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("score") + F.coalesce("escaped", F.lit(0.0))).alias("score"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
