"""Benchmark decontamination: pigeonhole edit matching.

An item and a text are compared lower-cased, with runs of white space as one space. An item of m characters has an error
budget of e = floor(rate * m) edits and is split into e + 1 pieces: wherever a text holds the item within e edits, at least
one piece is there unchanged. One Aho-Corasick automaton over all pieces finds these hits in whole texts; each places the
item, and places of one item less than e apart are verified together by Myers' bit-parallel distance of the item to the
best substring of the window around them.

The benchmark is a query set that goes to all tasks in blocks of at most about BLOCK_BYTES of text, one pass over the
documents for each block, each a job of its own with one automaton a worker. With several blocks a pass writes what it
finds (text's SHA-256, item, edits) to the shared folder, and all findings go back to the documents by the SHA-256.

Nulls and empty texts, or items without a character, match nothing. Repeated items are items of their own (equal finds of one item_id count once); repeated
rows get equal results; an item with a null item_id is left out. Empty tables: no rows, or no matches. Columns named like the
results (contaminated, item_ids, errors) are replaced, others kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, own_names, table

RATE = 0.05
BLOCK_BYTES = 2 << 20


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of nearly equal length that make up the item."""
    n = min(errors + 1, len(item))
    cuts = [k * len(item) // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def distance(item: str, text: str, most: int) -> int | None:
    """Least edit distance of item to a substring of text, None beyond most: Myers' algorithm, a column in two bit vectors."""
    m = len(item)
    if m <= most:
        return m if m else 0
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph <<= 1  # a match may begin anywhere in the text
        mh <<= 1
        pv = full & (mh | ~(xv | ph))
        mv = ph & xv & full
    return best if best <= most else None


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = [(i, p, int(rate * len(p))) for i, t in items if (p := plain(t))]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, errors) in enumerate(self.items):
            for offset, piece in pieces(text, errors):
                found.setdefault(piece, []).append((k, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, uses)
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def matches(self, text: str) -> list[tuple[int, int]]:
        """(item_id, errors) of the items within their budgets, by item."""
        if not self.any:
            return []
        text = plain(text)
        places: dict[int, set[int]] = {}
        for end, uses in self.automaton.iter(text):
            for k, after in uses:
                places.setdefault(k, set()).add(end + 1 - after)
        out = []
        for k, starts in places.items():
            item_id, item, errors = self.items[k]
            if any(s >= 0 and text.startswith(item, s) for s in starts):
                out.append((item_id, 0))
                continue
            best, at = None, sorted(starts)
            while at:
                n = 1  # places so near each other share a window
                while n < len(at) and at[n] - at[n - 1] <= errors:
                    n += 1
                lo, hi = max(0, at[0] - errors), at[n - 1] + len(item) + errors
                d = distance(item, text[lo:hi], errors)
                best = d if best is None or (d is not None and d < best) else best
                at = at[n:]
            if best is not None:
                out.append((item_id, best))
        return sorted(set(out))


_matchers: dict = {}


def matcher_of(items, rate: float) -> Matcher:
    """The worker's automaton of a block; the last one only is kept."""
    if _matchers.get("of") is not items.value:
        _matchers.update(of=items.value, matcher=Matcher(items.value, rate))
    return _matchers["matcher"]


def match_texts(items, rate: float, keep: list[str]):
    """Every row, with item_ids and errors of the items in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = matcher_of(items, rate).matches
        for batch in batches:
            found = [find(t) if t else [] for t in (x.as_py() for x in batch.column("text"))]
            ids = pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int64()))
            errors = pa.array([[e for _, e in f] for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], ids, errors], [*keep, "item_ids", "errors"])

    return run


def find_items(items, rate: float):
    """(sha, item_id, edits) of every item in a text: a row for each find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = matcher_of(items, rate).matches
        for batch in batches:
            found = [(sha, i, e) for sha, text in zip(batch.column("sha").to_pylist(), batch.column("text"), strict=True) for i, e in find(text.as_py() or "")]
            if found:
                sha, ids, errors = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), pa.array(ids, pa.int64()), pa.array(errors, pa.int32())], ["sha", "item_id", "edits"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with contaminated, item_ids (of all items found) and errors (edits of each); every row stays."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c.lower() not in {"contaminated", "item_ids", "errors"}]
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text") + 64).alias("b")).first()["b"] or 0
    n = max(1, -(-size // block_bytes))
    rows = docs.select(*keep)

    def block(k: int):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        return spark.sparkContext.broadcast(sorted((r["item_id"], r["text"]) for r in own.collect()))  # about block_bytes

    lists = [T.StructField("item_ids", T.ArrayType(T.LongType())), T.StructField("errors", T.ArrayType(T.IntegerType()))]
    if n == 1:
        found = rows.mapInArrow(match_texts(block(0), rate, keep), T.StructType([*rows.schema.fields, *lists]))
        return found.select(*keep, (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "errors")
    scratch = Scratch(spark, "decontamination")
    (name,) = own_names(keep, "sha")
    sha = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    texts = docs.select("text", sha.alias("sha"))
    parts = [scratch.write(texts.mapInArrow(find_items(block(k), rate), "sha binary, item_id long, edits int"), "found") for k in range(n)]
    every = reduce(DataFrame.union, parts).distinct()
    order = F.array_sort(F.collect_list(F.struct("item_id", "edits")))
    found = scratch.write(every.groupBy("sha").agg(order.alias("hits")).select(F.col("sha").alias(name), F.col("hits.item_id").alias("item_ids"), F.col("hits.edits").alias("errors")), "matches")
    joined = rows.withColumn(name, sha).join(found, name, "left")
    none = [F.coalesce(f.name, F.array().cast(f.dataType)).alias(f.name) for f in lists]
    return joined.select(*keep, F.col("item_ids").isNotNull().alias("contaminated"), *none)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "item_ids", "errors")
