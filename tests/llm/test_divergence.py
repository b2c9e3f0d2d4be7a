"""The divergence audit against plain counting with unbounded integers; its tokenizer, grouping and arithmetic on their own."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text)


def plain(rows, least_docs=3, top=200):
    docs = [(lang or "", source or "", TERM.findall(lower(text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        spread, counts = Counter(), defaultdict(Counter)
        for x, source, terms in docs:
            if x == lang:
                spread.update(set(terms))
                counts[source].update(terms)
        kept = {t for t, n in spread.items() if n >= least_docs}

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, df.collect()))


def test_documents(spark, documents):
    want = plain([(r.text, r.lang, r.source) for r in documents.collect()])
    assert len(want) > 1000
    assert got(D.op13_divergence(spark, SMALL)) == want


@pytest.mark.parametrize("hashed", [xxhash.xxh3_64_intdigest, lambda b: len(b) % 3, lambda b: 7])
def test_odd_texts_and_colliding_hashes(spark, hashed):
    r = random.Random(4)
    pool = ["Haus", "haus", "été", "ÉTÉ", "漢字", "a", "Z", "b2c", "x_y", "¡no!", "\x7f", "don't", "\U0001f44d", "ß"]
    rows = [(" ".join(r.choice(pool) for _ in range(r.randrange(30))), r.choice(["de", "fr", None]), r.choice(["s1", "s2", "ß", None, ""])) for _ in range(80)]
    rows += [(None, "de", "empty"), ("", "xx", "alone"), ("one two", "yy", "b"), ("one two", "yy", "a"), ("12", "zz", "c")]
    rows += [rows[0]] * 3
    docs = spark.createDataFrame([(*x, 1) for x in rows], "text string, lang string, source string, term int").repartition(5)
    assert got(D.audit(docs, hashed=hashed)) == plain(rows)
    assert got(D.audit(docs, least_docs=1, top=2, hashed=hashed)) == plain(rows, 1, 2)


def test_a_hot_source_and_small_blocks(spark):
    r = random.Random(6)
    words = ["w" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(400)]
    rows = [(" ".join(words[int(r.paretovariate(0.4)) % 400] for _ in range(60)), "en", "hot" if r.random() < 0.5 else f"s{r.randrange(12)}") for _ in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        assert got(D.audit(docs)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZé漢 1_{@[`\x7f"), max_size=8), max_size=8))
def test_tokenizer(texts):
    data = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, data)])
    block = D.LETTER[np.frombuffer(b"".join(data), np.uint8)]
    starts, ends = D.term_slices(block, off)
    found = [block[s:e].tobytes().decode() for s, e in zip(starts, ends, strict=True)]
    assert found == [t for x in texts for t in TERM.findall(lower(x))]
    for hashed in (xxhash.xxh3_64_intdigest, lambda b: 1, len):
        number, first = D.grouped(block, starts, ends, hashed)
        assert [found[first[n]] for n in number] == found
        assert len({found[i] for i in first}) == len(first)


def test_shares_are_exact(spark):
    r = random.Random(9)
    cases = [(c, t) for t in (1, 2, 3, 10**9, 10**15, 9 * 10**15 + 7) for c in (0, 1, t // 3, t - 1) if c < t]
    cases += [(r.randrange(t), t) for t in (r.randrange(1, 10**15) for _ in range(300))]
    want = [1 + 10**9 * (c + 1) // t for c, t in cases]
    assert D.share(np.array([c for c, _ in cases]), np.array([t for _, t in cases])).tolist() == want
    table = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "i int, c long, t long")
    assert [x[1] for x in sorted(table.select("i", D.share_of(F.col("c"), F.col("t"))).collect())] == want


def test_empty(spark):
    none = spark.createDataFrame([], "text string, lang string, source string")
    assert D.audit(none).collect() == []
    assert common.table(spark, SMALL, "documents").count() > 0
