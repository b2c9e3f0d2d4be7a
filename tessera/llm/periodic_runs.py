"""Periodic runs: stretches of words that repeat themselves several times over, found with a suffix automaton.

The automaton of a word sequence has a state for each class of factors with the same end positions. From the longest states
to the shortest, the ordered set of end positions of a state is merged into that of its suffix link, the smaller into the
larger. Each position that comes into a set meets its neighbours there; two neighbours whose distance does not exceed the
state's length end a square, and the state's length tells how far to the left it goes. A seed is then extended word by word
to the right, to a run. (Two ends of a run one period apart are neighbours in the state of their longest common suffix,
else the run would have a smaller period; so every run has such a seed at its own end. Neighbours that others part later give
multiples of a run's period over the run's own stretch; of these the smallest stays.)

A run of `repeats` periods and `shortest` words holds two equal factors of `factor_words` words one period apart, and such
factors cover it without a gap. So only stretches covered by repeated factors of that length need an automaton: they are found
by hashes in numpy, again inside each stretch until nothing more falls away, and no state shorter than that is merged. This
only saves work; equal hashes of different factors keep a stretch that holds no run.

Every document is worked on whole inside its row. Nulls and texts without words have no runs and an empty collapsed text.
Repeated rows are rows of their own, ties between runs are kept all, empty tables give no rows. Columns named like the
results (runs, collapsed) are replaced, all others kept, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_slices, table, text_bytes

SHORTEST, REPEATS = 24, 3
#: Bytes of text whose factors are hashed at a time, and positions in a block of an ordered set.
SLICE = 1 << 20
SET_BLOCK = 1024
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_STEP, _APART = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)

Run = tuple[int, int, int]


def factor_words(shortest: int, repeats: int) -> int:
    """The smallest number of words that two stretches of a run, one period apart, have in common."""
    return min(max(shortest - q, (repeats - 1) * q) for q in range(1, shortest + 1))


class Positions:
    """An ordered set of positions in blocks of bounded length, so that an insertion moves few of them."""

    __slots__ = ("blocks", "size")

    def __init__(self, first: int) -> None:
        self.blocks, self.size = [[first]], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def insert(self, x: int) -> tuple[int | None, int | None]:
        """Put x in; its neighbours before and after it."""
        blocks = self.blocks
        lo, hi = 0, len(blocks)
        while lo < hi:  # the first block that ends at x or later
            mid = (lo + hi) // 2
            if blocks[mid][-1] < x:
                lo = mid + 1
            else:
                hi = mid
        b = min(lo, len(blocks) - 1)
        block = blocks[b]
        i = bisect_left(block, x)
        before = block[i - 1] if i else blocks[b - 1][-1] if b else None
        after = block[i] if i < len(block) else blocks[b + 1][0] if b + 1 < len(blocks) else None
        block.insert(i, x)
        if len(block) > SET_BLOCK:
            half = len(block) // 2
            blocks[b : b + 1] = [block[:half], block[half:]]
        self.size += 1
        return before, after


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Of each state: the length of its longest factor, its suffix link, and its own end position (-1 for a copied state)."""
    length, link, own, after = [0], [-1], [-1], [{}]
    last = 0
    for i, w in enumerate(words):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        own.append(i)
        after.append({})
        p = last
        while p >= 0 and w not in after[p]:
            after[p][w] = new
            p = link[p]
        if p >= 0:
            q = after[p][w]
            if length[q] > length[p] + 1:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                own.append(-1)
                after.append(dict(after[q]))
                while p >= 0 and after[p].get(w) == q:
                    after[p][w] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        last = new
    return length, link, own


def seeds(words: list[int], shortest: int, repeats: int) -> set[tuple[int, int]]:
    """(start, period) of repetitions that reach `shortest` words and `repeats` periods: left-maximal, and long enough at the
    end position where they were met."""
    length, link, own = suffix_automaton(words)
    least = factor_words(shortest, repeats)
    sets: list[Positions | None] = [Positions(e) if e >= 0 and n >= least else None for e, n in zip(own, length, strict=True)]
    found: set[tuple[int, int]] = set()
    for v in np.argsort(-np.array(length), kind="stable").tolist():
        parent = link[v]
        if parent < 0 or length[parent] < least:
            sets[v] = None
            continue
        small, large, sets[v] = sets[v], sets[parent], None
        if large is None or large.size < small.size:
            small, large = large, small
        level = length[parent]
        for e in small or ():
            before, after = large.insert(e)
            for a, b in ((before, e), (e, after)):
                if a is not None and b is not None:
                    d = b - a
                    if d <= level and level + d >= shortest and level >= (repeats - 1) * d:
                        start = a - level + 1
                        if not start or words[start - 1] != words[start - 1 + d]:  # else both came from a longer state, which gave them
                            found.add((start, d))
        sets[parent] = large
    return found


def runs_of(words: list[int], shortest: int = SHORTEST, repeats: int = REPEATS) -> list[Run]:
    """All runs (start, length, period) of a word sequence, by start, then period."""
    n, smallest = len(words), {}
    for start, d in seeds(words, shortest, repeats):
        end = start + max(shortest, repeats * d)
        while end < n and words[end] == words[end - d]:
            end += 1
        at = (start, end - start)
        smallest[at] = min(d, smallest.get(at, d))
    return sorted((start, size, d) for (start, size), d in smallest.items())


def repeated_stretches(keys: np.ndarray, off: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Stretches [lo, hi) of the keys, each inside one text (off: the texts' n + 1 offsets), that may hold a factor of `width`
    keys twice and are covered by such factors: all others hold none."""
    lo, hi = off[:-1], off[1:]
    while True:
        wide = hi - lo >= width
        lo, hi = lo[wide], hi[wide]
        if not len(lo):
            return []
        number = np.repeat(np.arange(len(lo), dtype=np.uint64), hi - lo)
        at = np.arange(len(number)) - np.repeat(np.cumsum(hi - lo) - (hi - lo) - lo, hi - lo)
        total = np.zeros(len(at), np.uint64)
        own = keys[at]
        for k in range(width):  # a polynomial over the keys from here on; of the last ones of a stretch it is not used
            total = total * _STEP + np.roll(own, -k)
        fits = at + width <= np.repeat(hi, hi - lo)
        total = (total ^ (total >> np.uint64(31))) + number * _APART
        total, places = total[fits], np.flatnonzero(fits)
        order = np.argsort(total, kind="stable")
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = total[order[1:]] == total[order[:-1]]
        places = places[order[same[1:] | same[:-1]]]
        covered = np.zeros(len(at) + 1, np.int64)
        np.add.at(covered, places, 1)
        np.add.at(covered, np.minimum(places + width, len(at)), -1)
        full = np.cumsum(covered[:-1]) > 0
        if full.all():
            return list(zip(lo.tolist(), hi.tolist(), strict=True))
        edge = np.ones(len(at) + 1, bool)
        edge[1:-1] = (number[1:] != number[:-1]) | (full[1:] != full[:-1])
        edges = np.flatnonzero(edge)
        inside = full[edges[:-1]]
        lo, hi = at[edges[:-1][inside]], at[edges[1:][inside] - 1] + 1


def without_repeats(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words but those of a run after its first period."""
    if not runs:
        return words
    dropped = np.zeros(len(words), bool)
    for start, size, period in runs:
        dropped[start + period : start + size] = True
    return [w for w, gone in zip(words, dropped.tolist(), strict=True) if not gone]


def runs_of_texts(texts: list[bytes], shortest: int, repeats: int) -> Iterator[tuple[list[Run], bytes]]:
    """Of each text its runs and what is left of it."""
    split = [t.split() for t in texts]  # bytes are split at \x20 and \x09 to \x0D
    off = np.zeros(len(split) + 1, np.int64)
    np.cumsum([len(x) for x in split], out=off[1:])
    keys = np.fromiter((hash(w) for x in split for w in x), np.int64, int(off[-1])).view(np.uint64)
    found: dict[int, list[Run]] = {}
    for lo, hi in repeated_stretches(keys, off, factor_words(shortest, repeats)):
        doc = int(np.searchsorted(off, lo, "right")) - 1
        first = lo - int(off[doc])
        numbers: dict[bytes, int] = {}
        own = [numbers.setdefault(w, len(numbers)) for w in split[doc][first : first + hi - lo]]
        found.setdefault(doc, []).extend((start + first, size, d) for start, size, d in runs_of(own, shortest, repeats))
    for doc, x in enumerate(split):
        runs = sorted(found.get(doc, ()), key=lambda r: (r[0], r[2]))
        yield runs, b" ".join(without_repeats(x, runs))


def find_runs(keep: list[str], shortest: int, repeats: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column("text"))
            for lo, hi in row_slices(off, SLICE):
                texts = [raw[off[i] : off[i + 1]].tobytes() for i in range(lo, hi)]
                runs, left = zip(*runs_of_texts(texts, shortest, repeats), strict=True)
                rows = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs], _RUN)
                own = [batch.column(k).slice(lo, hi - lo) for k in keep]
                yield pa.RecordBatch.from_arrays([*own, rows, pa.array(left, pa.binary()).cast(pa.string())], [*keep, "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, repeats: int = REPEATS, keep: list[str] | None = None) -> DataFrame:
    """docs (of its columns those in keep, if given) with runs, by start, then period, of at least `shortest` words and
    `repeats` periods (2 or more), and collapsed: the words that no run repeats, joined by one space."""
    if repeats < 2 or shortest < repeats:
        raise ValueError("a run has two periods at least, and a word in each")
    kept = [c for c in docs.columns if c.lower() not in {"runs", "collapsed"} and (keep is None or c in keep)]
    rows = docs.select(*dict.fromkeys([*kept, "text"]))
    schema = T.StructType([*docs.select(*kept).schema.fields, *T._parse_datatype_string(f"runs {RUNS}, collapsed string").fields])
    return rows.mapInArrow(find_runs(kept, shortest, repeats), schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period, compared exactly; of equal ones the first."""
    better = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(better(r, best), r).otherwise(best))


def planted(text: Column, doc_id: Column) -> Column:
    """The text of a document in ten (by crc32 of its doc_id) with its words from some place on made periodic."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def periodic(x: Column) -> Column:
        n = F.size(x).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        turned = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(x, source(i).cast("int")))
        return F.when(n > 0, F.array_join(turned, " ")).otherwise(text)

    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), periodic), F.lit(0))).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs, keep=["doc_id"])
    best = strongest(F.col("runs"))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    listed = F.array_join(F.transform("runs", line), "")
    out = found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        hashed(listed).alias("runs_sha256"),
        hashed(F.col("collapsed")).alias("collapsed_sha256"),
    )
    milli = F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
