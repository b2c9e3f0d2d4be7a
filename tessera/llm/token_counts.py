"""Token counts: prefix dynamic programming over a byte-level BPE vocabulary.

A sequence of tokens is what BPE gives for its bytes exactly if each neighbouring pair is what BPE gives for the pair's
bytes. So the last token of the encoding of every prefix is found from the shorter prefixes: it is the one token that ends
there and is compatible with the last token before it; the count of a prefix is the earlier count plus one. The recurrence
runs once for each distinct piece (white space with the word, number or punctuation after it) that a worker meets, and
gives for every character how much the count of the prefix changes there. A text's changes end to end are its stored
table: their running sum is the exact count of every prefix, so counts, truncation and budgets are sums over the table,
without another look at the text. The query's own counts are the table's last sums.

The vocabulary is a public file named by a parameter; special tokens' strings inside a text count as one token each.

Nulls and empty texts have 0 bytes and 0 tokens. Repeated rows are rows of their own. Very long texts are counted whole.
Empty tables give no rows. Columns named like the results (n_tokens, prefix_chars, prefix_table) are replaced, others kept.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Fixed value: the pre-token pattern of the vocabulary's byte-level splitter.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of the prefix table: what stands before a piece does not change what the splitter makes of it.
PIECE = r"\s*(?:(?<! )'(?:s|t|re|ve|m|ll|d)|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+"
#: Bytes (about) of pieces and pairs that a worker remembers before it starts anew; longer pieces are not remembered.
REMEMBERED = 96 << 20
LONG_PIECE = 256


def byte_alphabet() -> dict[str, int]:
    """The vocabulary file's character for every byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter(dict):
    """Maps a piece to the changes of the token count at its characters, worked out on first use."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        listed = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        # Numbers in the order of merging: the bytes first, then each merge's result.
        self.vocab = {bytes([b]): b for b in range(256)}
        self.halves = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in listed:
            x, y = self.vocab[raw(a)], self.vocab[raw(b)]
            self.vocab.setdefault(raw(a) + raw(b), len(self.halves))
            self.merged[x, y] = len(self.halves)
            self.halves.append((x, y))
        self.longest = max(map(len, self.vocab))
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.split = regex.compile(PATTERN).findall
        self.pieces = regex.compile(PIECE).findall
        self.spaces = regex.compile(r"\s*").match  # the splitter's own white space, which is not Python's
        self.pairs: dict[int, bool] = {}
        self.held = 0

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a, b as they stand side by side. Undo the later of their merges step by step: what
        borders the seam at that stage must not have had an earlier merge across it."""
        key, before = a << 32 | b, 1 << 60  # merges numbered below `before` come sooner than the one undone last
        found = self.pairs.get(key)
        if found is not None:
            return found
        if len(self.pairs) > REMEMBERED >> 7:
            self.pairs.clear()
        merged, halves = self.merged, self.halves
        while True:
            if merged.get((a, b), 1 << 60) < before:
                found = False
                break
            if a < 256 and b < 256:
                found = True
                break
            if a > b:
                before, a = a, halves[a][1]
            else:  # of two merges with the same number the left one comes first
                before, b = b + 1, halves[b][0]
        self.pairs[key] = found
        return found

    def prefixes(self, data: bytes) -> list[int]:
        """Token count of every prefix of a pre-token, the empty one first."""
        last, count = [-1], [0]
        vocab, pairs, compatible, longest = self.vocab.get, self.pairs.get, self.compatible, self.longest
        for i in range(1, len(data) + 1):
            for j in range(max(0, i - longest), i):
                t = vocab(data[j:i])
                if t is None:
                    continue
                if j:
                    a = last[j]
                    ok = pairs(a << 32 | t)
                    if not (compatible(a, t) if ok is None else ok):
                        continue
                last.append(t)
                count.append(count[j] + 1)
                break
        return count

    def at_characters(self, piece: str) -> list[int]:
        """Token count of every prefix of what the splitter takes as one, by characters, the empty one first."""
        count = self.prefixes(piece.encode())
        if len(count) == len(piece) + 1:
            return count
        at, out = 0, [0]
        for c in piece:
            at += len(c.encode())
            out.append(count[at])
        return out

    def counts(self, piece: str) -> list[int]:
        """Token count of every prefix of a piece, each split as a text of its own would be."""
        head = self.spaces(piece).end()
        if piece[0].isalnum() or (head == 1 and piece[0] == " "):  # one for the splitter, as it stands
            return self.at_characters(piece)
        word = piece[head:]
        out = self.at_characters(piece[: len(piece) - len(word)])  # a run of white space at the end is one for the splitter
        if word[:1] == "'" and len(self.split(piece)[-1]) == len(word) > 1 and word[1:].isalpha():  # a contraction
            return out + [sum(self.at_characters(p)[-1] for p in self.split(piece[:k])) for k in range(len(out), len(piece) + 1)]
        if word:
            *before, last = self.split(piece)
            base = sum(self.at_characters(p)[-1] for p in before)
            out += [base + n for n in self.at_characters(last)[len(last) - len(word) + 1 :]]
        return out

    def __missing__(self, piece: str) -> bytes:
        counts = self.counts(piece)
        changes = array("h", map(sub, counts[1:], counts)).tobytes()
        if len(piece) <= LONG_PIECE:
            self.held += 3 * len(piece) + 192
            if self.held > REMEMBERED:
                self.clear()
                self.held = 0
            self[piece] = changes
        return changes

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at special strings; with each part whether it is one."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        yield text[at:], False

    def table(self, text: str) -> bytes:
        """The stored prefix table: for every character how much the count of the prefix changes there, 16 bits each."""
        if not (self.special and self.special.search(text)):
            return b"".join(map(self.__getitem__, self.pieces(text)))
        out, before = [], ""
        for part, special in self.segments(text):
            if special:  # up to its last character it is text like any other, which may join what stands before it
                almost = self.table(before + part[:-1])
                whole = self.count(before) + 1
                out += [almost, np.array([whole - count_at(almost, len(almost))], np.int16).tobytes()]
                before = ""
            else:
                before += part
        return b"".join([*out, self.table(before)])

    @staticmethod
    def sums(table: bytes) -> np.ndarray:
        """The exact token count of every prefix but the empty one."""
        return np.cumsum(np.frombuffer(table, np.int16), dtype=np.int64)

    def count(self, text: str) -> int:
        return int(np.frombuffer(self.table(text), np.int16).sum(dtype=np.int64))


def count_at(table: bytes, cut: int) -> int:
    """Tokens of the first `cut` characters, from the table."""
    return int(np.frombuffer(table, np.int16)[:cut].sum(dtype=np.int64))


def longest_prefix(table: bytes, budget: int) -> int:
    """The largest number of characters that have at most `budget` tokens, from the table."""
    within = np.flatnonzero(PrefixCounter.sums(table) <= budget)
    return int(within[-1]) + 1 if len(within) else 0


_counters: dict[str, PrefixCounter] = {}


def counter_of(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_texts(vocabulary: str, keep: list[str], budget: int | None, tables: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter_of(public_tokenizers.path(vocabulary))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                own = [c.table(x.as_py() or "") for x in part.column("text")]
                columns = {"n_tokens": pa.array([count_at(t, len(t)) for t in own], pa.int64())}
                if budget is not None:
                    columns["prefix_chars"] = pa.array([longest_prefix(t, budget) for t in own], pa.int64())
                if tables:
                    columns["prefix_table"] = pa.array(own, pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], *columns.values()], [*keep, *columns])

    return run


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, budget: int | None = None, tables: bool = False) -> DataFrame:
    """docs with n_tokens; with a budget also prefix_chars, the length of the longest prefix within it; with tables also
    prefix_table, from which count_at and longest_prefix answer for every cut and budget."""
    keep = [c for c in docs.columns if c.lower() not in {"n_tokens", "prefix_chars", "prefix_table"}]
    rows = docs.select(*keep)
    more = [T.StructField("prefix_chars", T.LongType())] if budget is not None else []
    more += [T.StructField("prefix_table", T.BinaryType())] if tables else []
    schema = T.StructType([*rows.schema.fields, T.StructField("n_tokens", T.LongType()), *more])
    return rows.mapInArrow(count_texts(vocabulary, keep, budget, tables), schema)


def truncate_texts(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [None if t is None else t[: longest_prefix(p, budget)] for t, p in zip(*(batch.column(k).to_pylist() for k in ("text", "prefix_table")), strict=True)]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(cuts, batch.schema.field(at).type))

    return run


def truncate_to_budget(counted: DataFrame, budget: int) -> DataFrame:
    """What count_tokens(tables=True) gave, each text cut to its longest prefix of at most budget tokens, found from the
    stored table alone (the counts and the table stay those of the whole text)."""
    return counted.mapInArrow(truncate_texts(budget), counted.schema)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), budget=LIMIT)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "prefix_chars")
