"""Source divergence audit: how far the word use of each source of a language lies from that of the other sources.

A byte-level tokenizer finds the terms: one lookup table over the concatenated UTF-8 buffer of a batch tells letters (ASCII
letters, lower-cased, and all bytes beyond ASCII) from everything else, and the places where it changes are the terms'
boundaries. A 64-bit xxhash groups the slices; every slice is compared with its group's first one byte by byte, and groups
that hold different bytes are parted. Counts of term, language and source, and of the documents with the term, are summed up
in Spark. A language keeps the terms of `least_docs` of its documents or more.

Each (language, source) and each language gives a kept term the share p = 1 + floor(10^9 (count + 1) / (N + V)): N, its
occurrences of all kept terms; V, the number of kept terms. The divergence of p from q at a term is floor((p - q)^2 / q).

Pairs of sources are compared in blocks of terms. A block is a sparse matrix in compressed rows, a row for each source; with
reduceat every source is held against one other at once, over the stored counts only. Terms that a source lacks have one and
the same share there, so they are counted, not visited. A task adds up its blocks and gives one number for each pair. The
terms that stand out in a source are a ranked window, whose limit Spark applies in every task before the shuffle.

All arithmetic is on integers; the shares by long division in steps of a thousand, so that counts up to 10^15 are exact.

Bounds: one row for each (language, source) goes to the driver and to all tasks, with as many numbers for a task as the
result has pairs. A row of the table of kept terms holds a term's counts by source.

Nulls in text, lang and source count as ''. Empty texts have no terms; their group has its rows all the same. Repeated rows
are documents of their own. Ties go by the item, byte by byte. Very long texts are cut into terms whole. Empty tables, and
languages with a single source, give no pairs. Of the input only text, lang and source are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, Scratch, row_slices, table, text_bytes

LEAST_DOCS, TOP = 3, 200
#: Bytes of text that are cut into terms at a time.
SLICE = 1 << 21

Hash = Callable[[bytes], int]


def letters() -> np.ndarray:
    """For every byte its lower-cased letter, or 0 where it belongs to no term."""
    t = LOWER.copy()
    t[:97] = 0
    t[123:128] = 0
    t[65:91] = np.arange(97, 123)
    return t


LETTER = letters()


def term_slices(block: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms in a buffer that went through the table; off: the texts' offsets."""
    full = np.zeros(len(block) + 2, bool)
    full[1:-1] = block != 0
    change = full[1:] != full[:-1]
    starts, ends = change & full[1:], change & full[:-1]
    seam = off[(off > 0) & (off < len(block))]
    seam = seam[full[seam] & full[seam + 1]]  # a term on either side
    starts[seam] = ends[seam] = True
    return np.flatnonzero(starts), np.flatnonzero(ends)


def grouped(block: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: Hash) -> tuple[np.ndarray, np.ndarray]:
    """A number for each slice, the same for the same bytes and only for these; and one slice of each number."""
    data = block.tobytes()
    keys = np.fromiter((hashed(data[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    size = ends - starts
    model = first[number]
    odd = size != size[model]
    same = np.flatnonzero(~odd)
    within = np.arange(int(size[same].sum())) - np.repeat(np.cumsum(size[same]) - size[same], size[same])
    at = within + np.repeat(starts[same], size[same])
    differs = block[at] != block[within + np.repeat(starts[model[same]], size[same])]
    if differs.any():
        odd[np.repeat(same, size[same])[differs]] = True
    if odd.any():  # other bytes under the same hash: numbers of their own
        own: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(odd).tolist():
            term = data[starts[i] : ends[i]]
            if term not in own:
                own[term] = len(first) + len(own)
                more.append(i)
            number[i] = own[term]
        first = np.concatenate([first, np.array(more, first.dtype)])
    return number, first


def count_slice(raw: np.ndarray, off: np.ndarray, group: np.ndarray, groups: int, hashed: Hash) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Terms, and for each its group of documents, occurrences and documents; group: a number below `groups` for each text."""
    block = LETTER[raw]
    starts, ends = term_slices(block, off)
    if not len(starts):
        return [], *(np.zeros(0, np.int64),) * 3
    number, first = grouped(block, starts, ends, hashed)
    doc = np.searchsorted(off, starts, "right") - 1
    pairs, times = np.unique(number * (len(off) - 1) + doc, return_counts=True)
    number, doc = np.divmod(pairs, len(off) - 1)
    cells = number * groups + group[doc]
    order = np.argsort(cells, kind="stable")
    cells, at = np.unique(cells[order], return_index=True)
    number, where = np.divmod(cells, groups)
    counts, docs = np.add.reduceat(times[order], at), np.diff(np.append(at, len(order)))
    data, lo, hi = block.tobytes(), starts[first[number]].tolist(), ends[first[number]].tolist()
    return [data[s:e] for s, e in zip(lo, hi, strict=True)], where, counts, docs


def count_terms(hashed: Hash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            cells = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            cells, group = np.unique(cells, return_inverse=True)
            langs, sources = (d.take(pa.array(x)) for d, x in zip((lang.dictionary, source.dictionary), np.divmod(cells, len(source.dictionary)), strict=True))
            raw, off = text_bytes(batch.column("text"))
            none = np.zeros(len(cells), np.int64)
            parts = [([None] * len(cells), np.arange(len(cells)), none, none)]
            for lo, hi in row_slices(off, SLICE):
                parts.append(count_slice(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], group[lo:hi], len(cells), hashed))
            for terms, where, counts, docs in parts:
                named = [d.take(pa.array(where)) for d in (langs, sources)]
                found = [pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(docs, pa.int64())]
                yield pa.RecordBatch.from_arrays([*named, *found], ["lang", "source", "term", "count", "docs"])

    return run


def term_counts(docs: DataFrame, hashed: Hash = xxhash.xxh3_64_intdigest) -> DataFrame:
    """(lang, source, term, count, docs) of all documents; every (lang, source) has a row with a null term and no counts."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("text"), text("lang"), text("source"))
    counted = rows.mapInArrow(count_terms(hashed), "lang string, source string, term string, count long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


# ---------------------------------------------------------------- shares and divergences, in numpy and in SQL


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), by long division."""
    whole, left = np.divmod(np.asarray(count, np.int64) + 1, total)
    for _ in range(3):
        more, left = np.divmod(left * 1000, total)
        whole = whole * 1000 + more
    return whole + 1


def share_of(count: Column, total: Column) -> Column:
    """The same as a Column."""
    out, left = F.call_function("div", count + 1, total), F.pmod(count + 1, total)
    for _ in range(3):
        out, left = out * 1000 + F.call_function("div", left * 1000, total), F.pmod(left * 1000, total)
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def row_sums(values: np.ndarray, indptr: np.ndarray) -> np.ndarray:
    """Sums of the stored values of each row of a matrix in compressed rows."""
    out = np.zeros(len(indptr) - 1, np.int64)
    full = indptr[1:] > indptr[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, indptr[:-1][full])
    return out


def block_divergences(indptr: np.ndarray, columns: np.ndarray, counts: np.ndarray, width: int, totals: np.ndarray) -> np.ndarray:
    """[i, j]: the divergence of row i from row j, summed over the block's `width` terms; totals: N + V of each row."""
    rows = np.repeat(np.arange(len(totals)), np.diff(indptr))
    stored, absent = share(counts, totals[rows]), share(np.zeros(len(totals), np.int64), totals)
    out = np.zeros((len(totals), len(totals)), np.int64)
    for j in range(len(totals)):
        own = slice(indptr[j], indptr[j + 1])
        q = np.full(width, absent[j])
        q[columns[own]] = stored[own]
        here = q[columns]
        out[:, j] = row_sums(apart(stored, here) - apart(absent[rows], here), indptr)  # what row i's counts change
        values, times = np.unique(stored[own], return_counts=True)
        for lo in range(0, len(values), 4096):
            out[:, j] += (apart(absent[:, None], values[None, lo : lo + 4096]) * times[lo : lo + 4096]).sum(axis=1)
        out[:, j] += (width - (indptr[j + 1] - indptr[j])) * apart(absent, absent[j])
    return out


def compare(groups: dict[str, tuple[list[str], list[int]]]):
    """groups: of each language its sources, in order, and their N + V."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                sources, totals = groups[lang]
                own = batch.column("per").take(pa.array(np.flatnonzero(langs.indices.to_numpy() == i)))
                flat = own.flatten()
                row = flat.field("source").dictionary_encode()
                at = {s: k for k, s in enumerate(sources)}
                rows = np.array([at[s] for s in row.dictionary.to_pylist()], np.int64)[row.indices.to_numpy()]
                columns = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())
                order = np.argsort(rows, kind="stable")
                indptr = np.searchsorted(rows[order], np.arange(len(sources) + 1))
                found = block_divergences(indptr, columns[order], flat.field("count").to_numpy()[order], len(own), np.array(totals, np.int64))
                sums[lang] = sums[lang] + found if lang in sums else found
        for lang, found in sums.items():
            sources = pa.array(groups[lang][0], pa.string())
            for k in range(len(sources)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(sources)), pa.array([groups[lang][0][k]] * len(sources)), sources, pa.array(found[k])],
                    ["lang", "source", "item", "value"],
                )

    return run


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, hashed: Hash = xxhash.xxh3_64_intdigest) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has every other source of the language with the divergence from
    it, part `term` the `top` terms by which the source stands out from its language."""
    scratch = Scratch(docs.sparkSession, "divergence")
    counted = scratch.write(term_counts(docs, hashed), "counts")
    per = F.collect_list(F.struct("source", "count")).alias("per")
    kept = counted.where("term is not null").groupBy("lang", "term").agg(per, F.sum("count").alias("in_lang"), F.sum("docs").alias("docs"))
    kept = scratch.write(kept.where(F.col("docs") >= least_docs).drop("docs"), "kept")
    by_source = kept.select("lang", "term", "in_lang", F.inline("per"))

    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_n"))
    sizes = by_source.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = counted.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", (F.coalesce("n", F.lit(0)) + F.coalesce("terms", F.lit(0))).alias("total"), (F.col("lang_n") + F.col("terms")).alias("lang_total"))
    groups = scratch.write(groups, "groups")
    own: dict[str, tuple[list[str], list[int]]] = {}
    for g in groups.orderBy("lang", "source").collect():  # the result has the square of these rows
        sources, totals = own.setdefault(g["lang"], ([], []))
        sources.append(g["source"])
        totals.append(g["total"])

    compared = kept.select("lang", "per").mapInArrow(compare(own), "lang string, source string, item string, value long")
    compared = compared.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").where("source <> item").join(compared, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    p, q = share_of(F.col("count"), F.col("total")), share_of(F.col("in_lang"), F.col("lang_total"))
    terms = by_source.join(groups, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    value = F.expr("(p - q) * (p - q) div q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    return pairs.select("*", rank).union(terms.select("*", rank).where(F.col("rank") <= top))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
