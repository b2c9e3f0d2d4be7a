"""Periodic runs against a search over all periods, on small alphabets, on the documents and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import periodic_runs as P

SMALL = "/root/testdata/sf0.001"


def plain_runs(words, shortest, repeats):
    """Every period in turn: longest stretches whose words equal those one period on."""
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if size >= max(shortest, repeats * q):
                found.setdefault((i, size), q)  # smaller periods come first
            i = j
    return sorted((s, size, q) for (s, size), q in found.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=60), st.sampled_from([(4, 2), (6, 3), (5, 2), (24, 3), (9, 4)]))
def test_small_alphabets(words, limits):
    assert P.runs_of(words, *limits) == plain_runs(words, *limits)


def test_longer_sequences():
    r = random.Random(3)
    for _ in range(60):
        words = [r.randrange(3) for _ in range(r.randrange(1, 30))] * r.randrange(1, 7) + [r.randrange(2) for _ in range(r.randrange(80))]
        words = words[: r.randrange(len(words) + 1)] + [r.randrange(4)] * r.randrange(40)
        for limits in ((24, 3), (8, 2)):
            assert P.runs_of(words, *limits) == plain_runs(words, *limits)


def test_texts_with_the_search_for_stretches():
    """What the hashes leave out holds no run; a text's runs do not depend on the texts beside it."""
    r = random.Random(5)
    texts = []
    for _ in range(200):
        words = []
        for _ in range(r.randrange(6)):
            part = [str(r.randrange(500)) for _ in range(r.randrange(1, 40))]
            words += part * r.choice([1, 1, 2, 3, 5]) + [str(r.randrange(500)) for _ in range(r.randrange(20))]
        texts.append(" ".join(words))
    some = 0
    for text, (runs, left) in zip(texts, P.runs_of_texts([t.encode() for t in texts], 24, 3), strict=True):
        words = text.split()
        assert runs == plain_runs(words, 24, 3)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        assert left.decode() == " ".join(w for i, w in enumerate(words) if i not in gone)
        some += len(runs)
    assert some > 50


def test_one_word_many_times():
    assert P.runs_of([7] * 30_000) == [(0, 30_000, 1)]
    assert P.runs_of([1, 2, 3] * 9_000) == [(0, 27_000, 3)]


def test_positions_in_blocks(monkeypatch):
    monkeypatch.setattr(P, "SET_BLOCK", 4)
    r, have = random.Random(1), [500]
    s = P.Positions(500)
    for x in r.sample([x for x in range(1000) if x != 500], 400):
        below, above = [y for y in have if y < x], [y for y in have if y > x]
        assert s.insert(x) == (max(below, default=None), min(above, default=None))
        have.append(x)
    assert list(s) == sorted(have) and s.size == 401


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 24, 3)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    tail = (sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *tail)


def test_query(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = {r.doc_id: tuple(r)[1:] for r in P.op11_periodic_runs(spark, SMALL).collect()}
    short = [i for i, t in texts.items() if len(t or "") < 20_000]
    assert set(got) == set(texts) and len(short) > 100
    assert {i: got[i] for i in short} == {i: expected(i, texts[i]) for i in short}
    assert any(x[0] for x in got.values())


def test_planted_on_odd_texts(spark, tmp_path):
    ids = [i for i in range(600) if zlib.crc32(str(i).encode()) % 10 == 0]
    r = random.Random(2)
    texts = [None, "", " \t\x0b", "one", "\x1c a b　c  d\x85", *[" ".join(str(r.randrange(9)) for _ in range(r.randrange(200))) for _ in ids[5:]]]
    rows = [*zip(ids, texts, strict=True), (ids[6], texts[6]), (601, "a " * 300)]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = sorted(map(tuple, P.op11_periodic_runs(spark, folder).collect()))
    assert got == sorted((i, *expected(i, t)) for i, t in rows)


def test_edges(spark):
    rows = spark.createDataFrame([(None, None, "x"), (1, "", "y"), (1, "la " * 40, "z"), (1, "la " * 40, "z")], "doc_id long, text string, runs string")
    got = P.periodic_runs(rows.withColumnRenamed("runs", "Collapsed"))
    assert got.columns == ["doc_id", "text", "runs", "collapsed"]
    assert sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()) == [("1", [], ""), ("1", [(0, 40, 1)], "la"), ("1", [(0, 40, 1)], "la"), ("None", [], "")]
    assert P.periodic_runs(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.periodic_runs(rows, repeats=1)
