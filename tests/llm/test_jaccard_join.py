"""The Jaccard join against all pairs of a small corpus, and its edge cases."""

from __future__ import annotations

import random
import re

import pytest

from tessera.llm import jaccard_join
from tessera.llm.jaccard_join import drop_near_copies, jaccard_components

SCHEMA = "doc_id long, text string, k string"


def sets(texts: dict, words: int) -> dict:
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    return out


def brute(texts: dict, words: int, percent: int) -> dict:
    s = sets(texts, words)
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s[i]), find(i)) for i in ids}


def corpus(seed: int) -> dict:
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts, n = {}, 0

    def put(t):
        nonlocal n
        texts[n] = t
        n += 1

    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([6, 30, 120, 300]))]
        put(" ".join(base))
        for _ in range(r.choice([0, 3, 14])):  # near copies at all distances around the threshold
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(vocab)
            put(" ".join(w[: len(w) - r.randrange(0, max(1, len(w) // 12))]))
    chain = [r.choice(vocab) for _ in range(100)]
    for k in range(12):  # each linked with the next, not with those farther on
        put(" ".join(chain[3 * k :] + [f"x{k}{j}" for j in range(3 * k)]))
    for _ in range(20):
        put("common words that are in many texts " + " ".join(r.choice(vocab) for _ in range(20)))
    for t in (None, "", "  \n", "one", "One", "one two", "A b\tc", "a B  c", "a b c d", "same same same same same same"):
        put(t)
        put(t)
    return texts


@pytest.mark.parametrize(("words", "percent", "seed"), [(4, 85, 1), (5, 80, 2)])
def test_equals_all_pairs(spark, words, percent, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, words, percent).collect()}
    assert got == brute(texts, words, percent)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", "n"), (7, "a b c d e f", "n"), (7, "a b c d e f", "n"), (9, "other text altogether", "n")], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()), key=str)
    assert got == [(7, 3, 7), (7, 3, 7), (9, 1, 9), (None, 3, 7)]
    assert jaccard_components(docs.limit(0)).count() == 0


def test_long_text(spark):
    words = [f"t{i}" for i in range(300_000)]
    near = words[:290_000]
    docs = spark.createDataFrame([(1, " ".join(words), ""), (2, " ".join(near), ""), (3, " ".join(words[:200_000]), "")], SCHEMA)
    got = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_small_tiles(spark, monkeypatch):
    """Tiles, copies of pivots and the join for wanted documents, at sizes where all of them are needed."""
    for name, value in (("TILE", 3), ("MEET", 2), ("MOST_WANTED", 3), ("TILE_BYTES", 400)):
        monkeypatch.setattr(jaccard_join, name, value)
    texts = corpus(3)
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, 4, 85).collect()}
    assert got == brute(texts, 4, 85)


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e f g", "x"), (3, "A b c d e f g", "y"), (None, "a b c d e f g", "z"), (None, "q r s t u v", "1"), (None, "q r s t u v", "2"), (8, "other text", "n"), (8, "third one", "n"), (None, None, "m"), (9, "", "m")]
    got = sorted(((r.doc_id, r.text) for r in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, id string")).collect()), key=str)
    assert got == sorted([(3, "A b c d e f g"), (None, "q r s t u v"), (8, "other text"), (8, "third one"), (None, None), (9, "")], key=str)
