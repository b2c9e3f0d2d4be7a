"""Packing against a plain pass over all tokens in the order that the sequences give, and ids against the vocabulary's library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing as P

SMALL = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))
ENCODER = P.encoder_of(P.VOCABULARY, P.RANKS)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_every_plain_character():
    """Both splitters see the same classes in Latin-1: each character beside letters, digits, spaces and signs."""
    for c in map(chr, range(256)):
        text = f"a{c}b{c}{c} {c}1{c} .{c}!  {c}\n{c}'s{c}"
        assert ENCODER.ids(text).tolist() == library(text), hex(ord(c))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0xFF), st.sampled_from(" \n\t'abetslri"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(text):
    assert ENCODER.ids(text).tolist() == library(text)


def test_random_letters():
    r = random.Random(1)
    for alphabet in ("ab", "aeinst", "lmosz 'd", "0123456789", "ACTG", "\x1c\x1f \n\x85\xa0a"):
        text = [("".join(r.choice(alphabet) for _ in range(r.randrange(200)))) for _ in range(400)]
        assert [ENCODER.ids(t).tolist() for t in text] == [library(t) for t in text]


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a<|endoftext|> b", "<|endof", "x" * 5000, " " * 3000, "漢字 é"])
def test_odd_texts(text):
    assert ENCODER.ids(text).tolist() == library(text)


def check(rows, pieces, length):
    """Each id of each row in one piece, sequences gapless and full but the last; rows: lists of ids by key."""
    by_sequence, by_doc = {}, {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        by_doc.setdefault(p["doc_id"], []).append(p)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    total = sum(len(ids) for ids in rows.values())
    for k, own in by_sequence.items():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == min(length, total - k * length)
        assert len({p["doc_id"] for p in own}) == len(own)  # a document is one piece there
    assert set(by_doc) == set(rows)
    for key, ids in rows.items():
        at = 0
        for p in sorted(by_doc[key], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)


def test_query(spark, documents):
    rows = {r.doc_id: [*library(r.text or ""), 1] for r in documents.collect()}
    pieces = [r.asDict() for r in P.op12_packing(spark, SMALL).collect()]
    check(rows, pieces, 2048)
    last = max(p["sequence_id"] for p in pieces)
    assert all((p["padding"] > 0) <= (p["sequence_id"] == last) for p in pieces)


@pytest.mark.parametrize("length,chunk", [(8, 64), (50, 20), (64, 64), (1, 7), (4096, 32)])
def test_lengths_and_chunks(spark, length, chunk):
    """Chunks shorter and longer than a sequence, and sequences that go over many chunks and partitions."""
    r = random.Random(length)
    texts = {i: " ".join(r.choice(["one", "two", "three", "naïve", "漢"]) for _ in range(r.choice([0, 1, 5, 40, 200]))) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    out = P.packed_sequences(docs, ["doc_id"], length, chunk_tokens=chunk).withColumn("p", F.explode("pieces"))
    crc = F.crc32(F.substring("ids", (F.col("p.offset") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int")))
    pieces = [x.asDict() for x in out.select("sequence_id", "p.*", crc.alias("ids_crc32")).collect()]
    check({i: [*library(t), 1] for i, t in texts.items()}, pieces, length)


def test_padding(spark):
    got = spark.createDataFrame([(x,) for x in (2048, 1024, 1000, 1)], "n long").select(P.padding(F.col("n"))).collect()
    assert [r[0] for r in got] == [0, 0, 1048, 0]


def test_edges(spark):
    rows = spark.createDataFrame([(None, None, 1), (2, "", 2), (2, "", 2), (2, "a b", 3)], "doc_id long, text string, part int")
    got = P.packed_sequences(rows, ["doc_id", "part"]).collect()
    assert [(r.sequence_id, r.size) for r in got] == [(0, 6)]
    assert sorted((str(p.doc_id), p.part, p.length, p.offset, p.doc_tokens) for p in got[0].pieces)[-1] == ("None", 1, 1, got[0].pieces[0].offset, 1) or len(got[0].pieces) == 4
    assert P.packed_sequences(rows.limit(0), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        P.packed_sequences(rows.withColumnRenamed("part", "Offset"), ["Offset"])


def test_chunks_are_read_in_small_parts(spark, monkeypatch):
    """A file with many chunks has many row groups, so no reader's batch holds a whole file's ids."""
    monkeypatch.setattr(P, "ROW_GROUP", 1 << 14)
    written = []
    write = P.Scratch.write

    def noted(self, df, name, *args, **more):
        out = write(self, df, name, *args, **more)
        written.extend((name, path.removeprefix("file:")) for path in out.inputFiles())
        return out

    monkeypatch.setattr(P.Scratch, "write", noted)
    docs = spark.range(400).selectExpr("id as doc_id", "repeat(sha2(string(id), 512), 4) as text").coalesce(1)
    total = P.packed_sequences(docs, ["doc_id"], chunk_tokens=512).agg(F.sum("size")).first()[0]
    [path] = [path.removeprefix("//") for name, path in written if name == "chunks"]
    found = pq.ParquetFile(path).metadata
    sizes = [found.row_group(i).num_rows for i in range(found.num_row_groups)]
    assert sum(sizes) == -(-total // 512) > 200 and max(sizes) <= 100
