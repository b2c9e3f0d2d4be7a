"""N-gram Jaccard join: all links between word-shingle sets at or above a threshold, without a missed pair.

1. Every text becomes its set of 64-bit shingle hashes; equal sets are one class (64-bit class hash), and all further work
   is on classes. A sketch of 2^20 counters (fixed size, broadcast) says roughly how common each shingle is.
2. A class stands under its rarest shingles: of n, the first n - ceil(t n) + 1 in (rarity, hash) order. Two sets at or
   above t share at least one of these, so a shingle's bucket is where a pair can meet.
3. A bucket's pivot is the class that has the shingle earliest in its order. Every class of the bucket is checked against
   the pivot alone: linked classes (the star) need no further partner search there, because the Jaccard distance is a
   metric: whatever links to a star member is within 2 (1 - t) of the pivot. Classes within that distance (the ring) meet
   the star and each other in tiles of bounded size, as differences from the pivot. What is left in a bucket meets in
   size-banded tiles, where bit counts of hashed 512-bit signatures bound the overlap from above.
4. Every candidate is verified by exact intersection of the sorted arrays, after the signatures' bound.
5. Links become components by large-star and small-star steps.

So a group of near copies costs one check against its pivot for each member, plus the tiles of its ring. No join gathers a
hot key in one task: a pivot of many pairs has its set once for every MEET of them, large buckets and balls are cut into
tiles that meet two by two. A task holds the sets of one slice of text, or of one batch of a bounded number of pairs. Sets
are not stored (they are nearly twice as large as the text): the texts of the classes that are wanted give them again.

Nulls and empty texts: the set is empty, the document is linked with nothing and its component is its own doc_id. Fewer
words than the shingle length: the whole sequence is the one shingle. Repeated rows fall in one class. A null doc_id never
becomes a component_id unless nothing else is in the component. Empty tables give no rows. Extra columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix64, own_names, row_slices, table, text_bytes, word_hashes
from .components import connected_components

SKETCH_BITS = 20
SEGMENTS = 16
SIGNATURE_WORDS = 8
#: Classes of a tile, and bytes of their differences from the pivot. Small groups are cut into more tiles than that, of
#: SMALL_TILE at least, so that none stands out among the tasks.
TILE = 512
SMALL_TILE = 128
TILE_BYTES = 2 << 20
#: Pairs that meet one copy of a pivot's set.
MEET = 256
#: Bits of the filter that tells which documents' sets are wanted; for more documents than MOST_WANTED a join does it.
WANTED_BITS = 22
MOST_WANTED = 1 << 20
SLICE = 1 << 19
#: Pairs that a task looks at together.
PAIRS = 128
#: Classes a task remembers having emitted.
SEEN = 1 << 17

I64 = pa.int64()


def shingle_sets(raw: np.ndarray, off: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    w, at = word_hashes(raw, off)
    h = w[: max(0, len(w) - words + 1)].copy()
    for k in range(1, words):
        h = mix64(h + np.uint64(k)) + w[k : k + len(h)]
    h = mix64(h)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= words:
            out.append(np.unique(h[lo : hi - words + 1]))
        elif hi > lo:
            short = w[lo : lo + 1].copy()
            for k in range(1, hi - lo):
                short = mix64(short + np.uint64(k)) + w[lo + k : lo + k + 1]
            out.append(mix64(short + np.uint64(0xABCD * (hi - lo))))
        else:
            out.append(h[:0])
    return out


def class_hash(s: np.ndarray) -> int:
    return int((mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))).astype(np.int64))


def texts_of(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        raw, off = text_bytes(batch.column("text"))
        for lo, hi in row_slices(off, SLICE):
            part = off[lo : hi + 1]
            yield batch.slice(lo, hi - lo), shingle_sets(raw[part[0] : part[-1]], part - part[0], words)


# ---------------------------------------------------------------- passes over the texts


def digests(words: int):
    """doc_id, mark, n, k for every text, and at the end of a task its part of the sketch: segment and counters."""
    schema = pa.schema([("doc_id", I64), ("mark", I64), ("n", I64), ("k", I64), ("segment", pa.int32()), ("counters", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        shift = np.uint64(64 - SKETCH_BITS)
        waiting, held = [], 0
        for batch, sets in texts_of(batches, words):
            waiting += [(s >> shift).astype(np.int32) for s in sets]
            held += sum(map(len, sets))
            if held > 1 << 18:
                sketch += np.bincount(np.concatenate(waiting), minlength=1 << SKETCH_BITS)
                waiting, held = [], 0
            n = len(sets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(I64), batch.column("mark"), pa.array([len(s) for s in sets], I64), pa.array([class_hash(s) for s in sets], I64), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        if waiting:
            sketch += np.bincount(np.concatenate(waiting), minlength=1 << SKETCH_BITS)
        parts = np.minimum(sketch, 2**31 - 1).astype(np.int32).reshape(SEGMENTS, -1)
        some = [i for i in range(SEGMENTS) if parts[i].any()]
        m = len(some)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, I64), pa.nulls(m, I64), pa.nulls(m, I64), pa.nulls(m, I64), pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], schema=schema)

    return run


def segment_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The summed counters of each segment in the partition as one byte a counter (its logarithm); at most SEGMENTS rows come out."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(c.as_buffer(), np.int32).astype(np.int64)
            total[s] = total[s] + x if s in total else x
    for s, x in total.items():
        level = np.minimum(255, 4 * np.log2(1.0 + x)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["segment", "levels"])


def rarity_levels(parts: DataFrame) -> np.ndarray:
    """The whole sketch as one byte a counter (its logarithm): 1 MB, whatever the input, and no more of it comes to the driver."""
    found = parts.repartition(SEGMENTS, "segment").mapInArrow(segment_levels, "segment int, levels binary").toArrow()
    levels = np.zeros((SEGMENTS, (1 << SKETCH_BITS) // SEGMENTS), np.uint8)
    for s, c in zip(found.column(0).to_pylist(), found.column(1), strict=True):
        levels[s] = np.frombuffer(c.as_buffer(), np.uint8)
    return levels.reshape(-1)


def prefixes(words: int, percent: int, levels):
    """token, k, n, pos for the prefix of every class that the task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = levels.value, set()
        for _, sets in texts_of(batches, words):
            tokens, ks, ns, pos = [], [], [], []
            for s in sets:
                n = len(s)
                if not n or (k := class_hash(s)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(k)
                p = n - -(-percent * n // 100) + 1
                rare = level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
                order = np.argsort((rare << np.uint64(56)) | (s >> np.uint64(8)), kind="stable")[:p]
                tokens.append(s[order])
                ks.append(np.full(p, k, np.int64))
                ns.append(np.full(p, n, np.int32))
                pos.append(np.arange(p, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).astype(np.int64)), pa.array(np.concatenate(ks)), pa.array(np.concatenate(ns)), pa.array(np.concatenate(pos))], ["token", "k", "n", "pos"])

    return run


def signature(s: np.ndarray) -> bytes:
    """A bitmap of the set's elements, two to four bits for each (512 at least); bit i of a shorter one is the or of the longer one's bits i modulo its length."""
    size = max(64 * SIGNATURE_WORDS, 1 << int(2 * len(s) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(mix64(s + np.uint64(77)) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> int:
    while len(bits) > size:
        half = len(bits) // 2
        x = int.from_bytes(bits[:half], "little") | int.from_bytes(bits[half:], "little")
        bits = x.to_bytes(half, "little")
    return int.from_bytes(bits, "little")


def slots(doc_id: pa.Array) -> np.ndarray:
    """Every document's bit of the filter; sets_of computes the same in Spark."""
    x = doc_id.cast(I64).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
    return ((x ^ (x >> np.uint64(WANTED_BITS))) & np.uint64((1 << WANTED_BITS) - 1)).astype(np.int64)


def wanted_sets(words: int, wanted, whole: bool):
    """k, n and the items (or the signature) of the documents in the filter (and of few others), or of all without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        own = batches
        if wanted is not None:
            want = np.unpackbits(wanted.value).view(bool)
            own = (b.filter(pa.array(want[slots(b.column("doc_id"))] | b.column("doc_id").is_null().to_numpy(zero_copy_only=False))) for b in batches)
        for _, sets in texts_of((b for b in own if b.num_rows), words):
            rows = []
            for s in sets:
                if len(s) and (k := class_hash(s)) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(k)
                    rows.append((k, len(s), s.tobytes() if whole else signature(s)))
            if rows:
                k, n, items = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, I64), pa.array(n, pa.int32()), pa.array(items, pa.binary())], ["k", "n", "items"])

    return run


def sets_of(docs: DataFrame, classes: DataFrame, words: int, pairs: DataFrame, whole: bool, scratch: Scratch) -> DataFrame:
    """k, n, items for (at least) the classes in the k and pk columns of pairs, each once, from one document of each."""
    named = pairs.select(F.explode(F.array("k", "pk")).alias("k")).distinct()
    least = scratch.write(classes.join(named, "k", "left_semi").where("least is not null").select("least").distinct(), "wanted")
    own, wanted = docs, None
    if least.count() > MOST_WANTED:
        named = docs.join(least.withColumnRenamed("least", "doc_id"), "doc_id", "left_semi").select(docs.columns)
        own = docs.where("doc_id is null").union(named)
    else:
        bit = F.col("least").bitwiseXOR(F.shiftrightunsigned("least", WANTED_BITS)).bitwiseAND(F.lit((1 << WANTED_BITS) - 1))
        found = least.select(bit.cast("int").alias("b")).distinct().toArrow()  # MOST_WANTED numbers at most
        bits = np.zeros(1 << WANTED_BITS, bool)
        bits[found.column(0).to_numpy()] = True
        wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))
    return own.mapInArrow(wanted_sets(words, wanted, whole), "k long, n int, items binary").dropDuplicates(["k"])


# ---------------------------------------------------------------- verification


def promising(percent: int):
    """The pairs whose signatures leave room for percent: bit counts of one without the other bound the overlap from above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for lo in range(0, batch.num_rows, PAIRS):
                part = batch.slice(lo, PAIRS)
                for n, m, x, y in zip(*(part.column(c).to_pylist() for c in ("n", "pn", "items", "p_items")), strict=True):
                    size = min(len(x), len(y))
                    a, b = folded(x, size), folded(y, size)
                    bound = min(n - (a & ~b).bit_count(), m - (b & ~a).bit_count())
                    keep.append((100 + percent) * bound >= percent * (n + m))
            yield batch.select(["k", "pk"]).filter(pa.array(keep, pa.bool_()))

    return run


def verify(percent: int, near: int):
    """Pairs with both sets -> those at least near percent alike: state 2 when linked, else 1; less = |pivot - set|, delta = the symmetric difference."""
    schema = pa.schema([("k", I64), ("pk", I64), ("n", pa.int32()), ("pn", pa.int32()), ("state", pa.int32()), ("less", pa.int32()), ("delta", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("k", "pk", "items", "p_items")]
            for lo in range(0, batch.num_rows, PAIRS):
                out = []
                for i in range(lo, min(lo + PAIRS, batch.num_rows)):
                    k, pk, x, y = (c[i] for c in columns)
                    a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(a) + len(b)
                    apart = np.setxor1d(a, b, assume_unique=True)
                    shared = (both - len(apart)) // 2
                    if (100 + near) * shared >= near * both:
                        out.append((k.as_py(), pk.as_py(), len(a), len(b), 1 + ((100 + percent) * shared >= percent * both), len(b) - shared, apart.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


CHECKED = "k long, pk long, n int, pn int, state int, less int, delta binary"


def with_sets(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """pairs (k, pk; a written table) with n, items of k and pn, p_items of pk. A pivot of more than MEET pairs has its set
    once for each MEET of them."""
    many = pairs.groupBy("pk").agg(F.count("*").alias("c")).where(F.col("c") > MEET)
    many = scratch.write(many.select("pk", F.ceil(F.col("c") / MEET).cast("int").alias("g")), "many")
    spread = pairs.join(many, "pk", "left").select("k", "pk", F.coalesce(F.pmod(F.xxhash64("k"), F.col("g")), F.lit(0)).cast("int").alias("s"))
    pivot = sets.select(F.col("k").alias("pk"), F.col("n").alias("pn"), F.col("items").alias("p_items")).join(many, "pk", "left")
    pivot = pivot.withColumn("s", F.explode(F.sequence(F.lit(0), F.coalesce("g", F.lit(1)) - 1))).drop("g")
    return spread.join(sets, "k").join(pivot, ["pk", "s"]).drop("s")


def could_link(percent: int, n: Column, pos: Column, m: Column, at: Column) -> Column:
    """Sizes and places of a common shingle leave room for the needed overlap."""
    most = F.least(pos, at) + 1 + F.least(n - pos - 1, m - at - 1)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (most * (100 + percent) >= (n + m) * percent)


def ring_links(percent: int):
    """Two tiles of a pivot's ball: links of ring classes to the star (an edge to the pivot) and to one another (a forest)."""

    def run(tile: pa.Table) -> pa.Table:
        k = tile.column("k").to_numpy()
        pk, pn = tile.column("pk")[0].as_py(), tile.column("pn")[0].as_py()
        n = tile.column("n").to_numpy().astype(np.int64)
        less = tile.column("less").to_numpy().astype(np.int64)
        ring = tile.column("state").to_numpy() == 1
        deltas = [np.frombuffer(x.as_buffer(), np.uint64) for x in tile.column("delta").combine_chunks()]
        row = np.repeat(np.arange(len(k), dtype=np.int32), [len(d) for d in deltas])
        _, col, count = np.unique(np.concatenate(deltas), return_inverse=True, return_counts=True)
        rank = np.cumsum(count > 1) - 1
        row, col = row[count[col] > 1], rank[col[count[col] > 1]]
        dot = np.zeros((int(ring.sum()), len(k)), np.float32)
        for lo in range(0, int(col.max()) + 1 if len(col) else 0, 1024):
            own = (col >= lo) & (col < lo + 1024)
            m = np.zeros((len(k), 1024), np.float32)
            m[row[own], col[own] - lo] = 1
            dot += m[ring] @ m.T
        linked = np.zeros(dot.shape, bool)
        for i, at in enumerate(np.flatnonzero(ring)):
            shared = pn - less[at] - less + dot[i].astype(np.int64)
            linked[i] = (100 + percent) * shared >= percent * (n[at] + n)
        star = linked[:, ~ring].any(axis=1)
        u, v = k[ring][star].tolist(), [pk] * int(star.sum())
        own = k[ring]
        root = list(range(len(own)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in zip(*np.nonzero(np.triu(linked[:, ring], 1)), strict=True):
            a, b = find(int(i)), find(int(j))
            if a != b:
                root[a] = b
                u.append(int(own[i]))
                v.append(int(own[j]))
        return pa.table({"u": pa.array(u, I64), "v": pa.array(v, I64)})

    return run


def tile_of(count: Column) -> Column:
    return F.least(F.lit(TILE), F.greatest(F.lit(min(TILE, SMALL_TILE)), F.ceil(count / 32)))


def ball_links(checked: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Edges of the ring of every pivot: what is near the pivot without a link to it meets all that is near it, in pairs of
    tiles of the ball. Ring tiles meet ring and star tiles, star tiles do not meet one another."""
    ring = F.col("state") == 1
    tile = tile_of(F.count("*"))
    size = F.greatest(F.count(F.when(ring, 1)) / tile, F.sum(F.when(ring, F.octet_length("delta"))) / TILE_BYTES)
    rest = F.greatest(F.count(F.when(~ring, 1)) / tile, F.coalesce(F.sum(F.when(~ring, F.octet_length("delta"))), F.lit(0)) / TILE_BYTES)
    balls = checked.groupBy("pk").agg(F.ceil(size).cast("int").alias("r"), F.ceil(rest).cast("int").alias("s"), F.count("*").alias("c"), F.min("state").alias("least"))
    balls = scratch.write(balls.where("least = 1 and c > 1").select("pk", "r", "s"), "balls")
    spread = checked.join(balls, "pk")
    h = F.xxhash64("k")
    own = F.when(ring, F.pmod(h, F.col("r"))).otherwise(F.col("r") + F.pmod(h, F.greatest("s", F.lit(1)))).cast("int")
    spread = spread.withColumn("h", own)
    last = F.when(ring, F.col("r") + F.col("s")).otherwise(F.col("r")) - 1
    spread = spread.withColumn("o", F.explode(F.sequence(F.lit(0), last)))
    spread = spread.select("k", "pk", "n", "pn", "state", "less", "delta", F.least("h", "o").alias("i"), F.greatest("h", "o").alias("j"))
    return spread.groupBy("pk", "i", "j").applyInArrow(ring_links(percent), "u long, v long")


def bucket_links(met: DataFrame, checked: DataFrame, signs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """k, pk: the pairs of a bucket, neither linked to its pivot, that signatures, sizes and places leave open: size bands of
    a bucket, cut into tiles that meet two by two."""
    left = met.join(checked.select("k", "pk", "state"), ["k", "pk"], "left").where("state is null or state = 1")
    left = scratch.write(left.select("token", "k", "n", "pos", F.col("state").isNotNull().alias("ring")).distinct(), "left")
    open_ = left.groupBy("token").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.min("ring").alias("ring"), F.count("*").alias("c")).where("lo < hi and not ring")
    open_ = scratch.write(open_.select("token", F.ceil(F.col("c") / tile_of(F.col("c"))).cast("int").alias("g")), "open")
    short = F.lit(64 * SIGNATURE_WORDS // 8)
    rows = left.join(open_, "token").join(signs.select("k", "items"), "k")
    rows = rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int"))
    for i in range(SIGNATURE_WORDS):  # signatures of one length only, the shortest; longer ones are left to the check of pairs
        word = F.conv(F.hex(F.substring("items", 8 * i + 1, 8)), 16, -10).cast("long")
        rows = rows.withColumn(f"b{i}", F.when(F.octet_length("items") == short, word))
    rows = rows.drop("items").withColumn("h", F.pmod(F.xxhash64("k"), F.col("g")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).withColumns({"i": F.least("h", "o"), "j": F.greatest("h", "o")}).drop("o", "g")
    right = rows.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    a, b = rows.alias("a"), right.alias("b")
    over = [sum(F.bit_count(F.col(f"{s}.b{i}").bitwiseAND(F.bitwise_not(F.col(f"{t}.b{i}")))) for i in range(SIGNATURE_WORDS)) for s, t in ("ab", "ba")]
    bound = F.coalesce(F.least(F.col("a.n") - over[0], F.col("b.n") - over[1]), F.least("a.n", "b.n"))
    tiles = (
        (F.col("a.token") == F.col("b.token"))
        & (F.col("a.band") == F.col("b.band"))
        & (F.col("a.i") == F.col("b.i"))
        & (F.col("a.j") == F.col("b.j"))
        & ((F.col("a.h") != F.col("b.h")) | (F.col("a.i") == F.col("a.j")))
        & (F.col("a.k") < F.col("b.k"))
        & ~(F.col("a.ring") & F.col("b.ring"))
        & could_link(percent, F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos"))
        & (bound * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent)
    )
    return a.join(b, tiles).select(F.col("a.k").alias("k"), F.col("b.k").alias("pk")).distinct()


def links(docs: DataFrame, words: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(digests, classes, edges): doc_id, mark (a hash of the text), n, k of every document; k and the least doc_id of every non-empty class; u, v: class
    hashes, a set of links with the same components as all links."""
    spark = docs.sparkSession
    near = max(1, 2 * percent - 100)  # within twice the distance
    docs = docs.select("doc_id", "text")
    marked = docs.withColumn("mark", F.xxhash64("text"))
    first = scratch.write(marked.mapInArrow(digests(words), "doc_id long, mark long, n long, k long, segment int, counters binary"), "digests")
    levels = spark.sparkContext.broadcast(rarity_levels(first.where("segment is not null").select("segment", "counters")))
    own = first.where("segment is null").select("doc_id", "mark", "n", "k")
    classes = scratch.write(own.where("n > 0").groupBy("k").agg(F.min("doc_id").alias("least")), "classes")

    # A bucket's pivot: the least (pos, n, part of k), packed in one number so that the grouping hashes.
    rows = scratch.write(docs.mapInArrow(prefixes(words, percent, levels), "token long, k long, n int, pos int"), "prefixes")
    place = F.shiftleft(F.col("pos").cast("long"), 39) + F.shiftleft(F.col("n").cast("long"), 14) + F.col("k").bitwiseAND(F.lit((1 << 14) - 1))
    buckets = rows.groupBy("token").agg(F.min_by("k", place).alias("pk"), F.min(place).alias("place"), F.count("*").alias("c")).where("c > 1")
    pivots = buckets.select("token", "pk", F.shiftright("place", 39).cast("int").alias("ppos"), F.shiftright("place", 14).bitwiseAND(F.lit((1 << 25) - 1)).cast("int").alias("pn"))
    met = scratch.write(rows.join(pivots, "token").where("k <> pk"), "met")
    scratch.drop(rows)
    pairs = scratch.write(met.where(could_link(near, F.col("n"), F.col("pos"), F.col("pn"), F.col("ppos"))).select("k", "pk").distinct(), "pairs")
    signs = scratch.write(sets_of(docs, classes, words, met, False, scratch), "signatures")
    hopeful = scratch.write(with_sets(pairs, signs, scratch).mapInArrow(promising(near), "k long, pk long"), "hopeful")
    sets = sets_of(docs, classes, words, hopeful, True, scratch)
    checked = scratch.write(with_sets(hopeful, sets, scratch).mapInArrow(verify(percent, near), CHECKED), "checked")
    scratch.drop(pairs, hopeful)
    edges = checked.where("state = 2").select(F.col("k").alias("u"), F.col("pk").alias("v"))
    edges = edges.union(ball_links(checked, percent, scratch))

    rest = scratch.write(bucket_links(met, checked, signs, percent, scratch), "rest")
    rest = scratch.write(with_sets(rest, signs, scratch).mapInArrow(promising(percent), "k long, pk long"), "rest")
    if not rest.isEmpty():
        found = with_sets(rest, sets_of(docs, classes, words, rest, True, scratch), scratch).mapInArrow(verify(percent, percent), CHECKED)
        edges = edges.union(found.select("k", "pk"))
    edges = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    scratch.drop(met, signs, checked, rest)
    return own, classes, edges


def jaccard_groups(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, mark (xxhash64 of the text), n (shingles), root (a number of the component; null without shingles),
    component_id (its smallest doc_id) of every document."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    own, classes, edges = links(docs, words, percent, scratch)
    roots = connected_components(edges, scratch)
    rooted = scratch.write(classes.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k")), "rooted")
    least = scratch.write(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    found = rooted.select("k", "root").join(least, "root").select("k", "root", "component_id")
    joined = own.withColumn("k", F.when(F.col("n") > 0, F.col("k"))).join(found, "k", "left")
    return joined.select("doc_id", "mark", "n", "root", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links of at least percent/100)."""
    return jaccard_groups(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id (a null one only where there is no other), of
    several the one with the smallest hash of its text. Rows without a word are in no component and all stay, but for rows
    equal in doc_id and text, of which one stays."""
    found = jaccard_groups(docs, words, percent)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    best = found.where("n > 0").groupBy("root").agg(F.min_by(F.struct("doc_id", "mark"), first).alias("best")).select("best.doc_id", "best.mark")
    stay = best.union(found.where("n = 0").select("doc_id", "mark").distinct())
    id_, none, mark = own_names(docs.columns, "id", "none", "mark")
    keys = [F.coalesce("doc_id", F.lit(0)).alias(id_), F.col("doc_id").isNull().alias(none)]
    rows = docs.select("*", *keys, F.xxhash64("text").alias(mark))
    stay = stay.select(*keys, F.col("mark").alias(mark))
    return rows.join(stay, [id_, none, mark], "left_semi").dropDuplicates([id_, none, mark]).select(docs.columns)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
