"""The corpus pipeline: every stage's decision takes effect, and clean documents stay."""

from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def words(r, vocab, n):
    return " ".join(r.choice(vocab) for _ in range(n))


def test_pipeline(spark, tmp_path):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9))) for _ in range(3000)]
    texts = {i: words(r, vocab, 60) for i in range(60)}
    copy = texts[1].split()
    copy[7] = "changed"
    texts |= {100: texts[0], 101: " ".join(copy), 102: "1234 5678", 103: None}
    item = words(r, vocab, 15)
    texts[104] = words(r, vocab, 30) + " " + item + " " + words(r, vocab, 30)
    rows = [(i, t, "en" if i % 2 else "de", "s1", len(t or "")) for i, t in texts.items()]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept, docs = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = sorted(x.doc_id for x in docs.select("doc_id").collect())
    every = set(texts)
    assert set(kept["language_id"]) == every - {102, 103}
    assert set(kept["jaccard_join"]) == every - {102, 103, 100, 101}
    assert set(kept["decontamination"]) == every - {102, 103, 100, 101, 104}
    assert set(kept["mixing"]) == set(kept["decontamination"])
    assert kept["sharding"] == kept["mixing"]
    assert {"shard", "slot"} <= set(docs.columns)
    assert [x.doc_id for x in corpus_pipeline.run(spark, folder).orderBy("doc_id").collect()] == kept["sharding"]


CLASHING = "size int, Score string, errors string, item_ids string, target string, shard int, held_out string, k string"


def test_clashing_columns_nulls_and_repeated_rows(spark, tmp_path):
    """Columns named like results come through every stage as they were; null and repeated rows have their stated fate."""
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9))) for _ in range(3000)]
    rows = [(i, words(r, vocab, 50), "en", "s1" if i % 3 else None, 1) for i in range(40)]
    rows += [(None, words(r, vocab, 50), "en", "s1", 1), (50, None, "en", "s1", 1), (51, "", "en", None, 1), rows[4], (4, words(r, vocab, 50), None, "s1", 1)]
    rows.append((60, words(r, vocab, 30_000), "en", "s1", 1))
    own = lambda i: (i, f"x{i}", "a", "b", "c", i + 7, "d", "e")
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(*x, *own(x[0] or 0)) for x in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, words(r, vocab, 15))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        moved = {"size": "size_", "shard": "shard_"} if name == "sharding" else {}
        assert docs.columns[: len(names)] == [moved.get(c, c) for c in names]
        got = docs.collect()
        assert all(tuple(x)[5:13] == own(x["doc_id"] or 0) for x in got)
        kept = sorted(str(x["doc_id"]) for x in got)
        want = [*range(40), 4, 60, None] if name != "language_id" else [*range(40), 4, 4, 60, None]
        if name in ("language_id", "jaccard_join", "decontamination"):
            assert kept == sorted(map(str, want))
        else:
            assert set(kept) <= set(map(str, want)) and len(kept) > 20
    assert {"size", "shard", "slot", "text_crc32"} <= set(docs.columns)


def test_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
