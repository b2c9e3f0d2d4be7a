"""Weighted fair queueing against the water-filling rule; shards against rendezvous hashing and gapless slots."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import common, mixing, sharding
from tessera.llm.mixing import mix, mixed_queue
from tessera.llm.sharding import fisher_yates, op10_sharding, shuffle_into_shards, write_shards

SMALL = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, source string"


def targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        share = sum(w[s] for s in order if s not in full)
        out = {s: 3.0 * sizes[s] if s in full else left * w[s] / share for s in order}
        over = {s for s in order if s not in full and out[s] > 3 * sizes[s]}
        if not over:
            return out
        full |= over


def sample(seed: int):
    r = random.Random(seed)
    many = [(i, " ".join("w" for _ in range(r.randrange(0, 40))), r.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(600)]
    return [*many, (700, None, "a"), (701, "", "tiny"), (702, "one", "small"), (703, "x " * 20_000, "b"), (None, "two words", "c"), (None, "two words", "c")]


def test_mix(spark):
    rows = sample(3)
    got = mix(spark.createDataFrame(rows, DOCS)).collect()
    sizes, taken = Counter(), Counter()
    for i, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = mix(spark.createDataFrame(random.Random(1).sample(rows, len(rows)), DOCS).repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def plain_queue(rows: list, place: dict, repeats: int = 3) -> dict:
    """Fluid fair queueing by a plain loop: every source serves its own order at its weight's rate until all words are spent;
    gives the words taken of each row (by index)."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    totals = Counter()
    for i, (_, _, s) in enumerate(rows):
        totals[s] += size[i]
    want, taken = targets(totals), Counter()
    for s in totals:
        own = sorted((i for i in range(len(rows)) if rows[i][2] == s), key=place.get)
        left = int(want[s] + 1e-6)
        for i in own * repeats:
            taken[i] += min(size[i], left)
            left -= min(size[i], left)
    return taken


def md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def test_equals_plain_queue(spark, monkeypatch):
    """Against the plain loop, with the ranges of the prefix sum so small that there are many levels."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 8)
    rows = [(i, t, s) for i, (_, t, s) in enumerate(sample(4))]
    place = {i: md5(f"9:{i}:{md5(t or '')}") for i, t, _ in rows}
    want = plain_queue(rows, place)
    got = mix(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert {r.doc_id: r.taken for r in got} == {i: want[i] for i, _, _ in rows}


def test_queue_and_empty(spark):
    docs = spark.createDataFrame([(i, "a b c", "a" if i else "b") for i in range(9)], DOCS)
    queue = mixed_queue(docs)
    kept = queue.collect()
    assert queue.columns == ["doc_id", "text", "source", "virtual_finish"] and 7 <= len(kept) <= 11
    assert [r.virtual_finish for r in kept] == sorted(r.virtual_finish for r in kept)
    assert Counter(r.source for r in kept)["b"] == 3  # its target is beyond three times its size
    assert mix(docs.limit(0)).count() == 0 and mixed_queue(docs.limit(0)).count() == 0


def test_hot_copies(spark, monkeypatch):
    """A third of all rows equal in everything: numbered and spread, words still taken to the target, each within its bounds."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    rows = [(None, "same words here", "a")] * 400 + [(i, f"w{i} x", "a" if i % 2 else "b") for i in range(800)]
    got = mix(spark.createDataFrame(rows, DOCS).repartition(6)).collect()
    taken, sizes = Counter(), Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        sizes[r.source] += r.size
    assert len(got) == len(rows) and all(abs(taken[s] - t) <= 1 for s, t in targets(sizes).items())
    same = sorted(r.taken for r in got if r.doc_id is None)
    assert len(set(same)) > 1  # not all in one place of the order
    again = mix(spark.createDataFrame(random.Random(2).sample(rows, len(rows)), DOCS).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_clashing_columns(spark):
    names = ["_at", "_range", "_crc", "_bucket", "_i", "src", "copy", "place", "range", "queued", "taken", "bucket", "perm", "hot", "part", "n"]
    docs = spark.createDataFrame([(i, f"a b {i}", "s", *[f"mine {c}" for c in names]) for i in range(30)], ["doc_id", "text", "source", *names])
    for out, lost in ((mix(docs), {"taken"}), (mixed_queue(docs), {"taken"}), (shuffle_into_shards(docs), set())):
        for r in out.collect():
            assert all(r[c] == f"mine {c}" for c in names if c not in lost)
    assert {r.taken for r in mix(docs).collect()} == {3}


def test_number_copies(spark, tmp_path):
    rows = [(None, "x")] * 50 + [(1, "y")] * 3 + [(2, "z")] * 40 + [(i, "q") for i in range(10, 40)]
    out = common.number_copies(spark.createDataFrame(rows, "a long, b string").repartition(5), ["a", "b"], 20, "no", common.Scratch(spark, "test")).collect()
    by = defaultdict(list)
    for r in out:
        by[r.a, r.b].append(r.no)
    assert sorted(by[None, "x"]) == list(range(50)) and sorted(by[2, "z"]) == list(range(40)) and by[1, "y"] == [0, 0, 0]
    assert sum(map(len, by.values())) == len(rows)


def test_running_sum(spark):
    rows = [(s, i, i % 7) for s in "ab" for i in range(0, 300, 3)]
    out = common.running_sum(spark.createDataFrame(rows, "s string, i long, v long"), ["s"], "i", "v", "before", 16).collect()
    assert all(r.before == sum(v for s, i, v in rows if s == r.s and i < r.i) for r in out) and len(out) == len(rows)


def test_shards(spark, documents):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    got = op10_sharding(spark, SMALL).collect()
    slots = defaultdict(list)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    assert 0 < sum(r.grown_shard == 8 for r in got) < len(got) / 3
    assert sorted(map(tuple, got)) == sorted(map(tuple, op10_sharding(spark, SMALL).collect()))


def test_fisher_yates(spark):
    from pyspark.sql import functions as F

    rows = spark.range(50).select("id", fisher_yates(F.lit(20), F.col("id")).alias("p")).collect()
    assert all(sorted(r.p) == list(range(20)) for r in rows)
    assert len({tuple(r.p) for r in rows}) == 50
    assert len({r.p[0] for r in rows}) > 10


def test_shards_edges(spark, tmp_path):
    rows = [(None, None, "a"), (None, "x", "b"), (3, "y", "c"), (3, "y", "c"), (4, "z" * 100_000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = shuffle_into_shards(docs).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 5 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shuffle_into_shards(docs.limit(0)).count() == 0
    write_shards(docs, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 5


def test_hot_key(spark, monkeypatch):
    """A third of all rows under one doc_id, or equal in everything: slots stay gapless, and no bucket holds them all."""
    monkeypatch.setattr(sharding, "EQUAL_ROWS", 100)
    for text in ("cast(id as string)", "if(id % 3 = 0, 'same', cast(id as string))"):
        docs = spark.range(9000).selectExpr("if(id % 3 = 0, null, id) as doc_id", f"{text} as text").repartition(6)
        got = shuffle_into_shards(docs).collect()
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert len(got) == 9000 and all(sorted(s) == list(range(len(s))) for s in slots.values())
        hot = sorted(r.slot for r in got if r.doc_id is None)
        assert hot[-1] - hot[0] >= len(hot)  # other rows stand between them


def test_plain_version(spark):
    """Rendezvous hashing and Fisher-Yates by plain loops over Spark's own hash values."""
    from pyspark.sql import functions as F

    rows = [(i, f"text {i % 40}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.shard, r.slot) for r in shuffle_into_shards(docs, 4, 20).collect()}
    tried = docs.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"), F.array(*[F.xxhash64(F.lit(20), "doc_id", F.lit(s)) for s in range(4)]).alias("h")).collect()
    shard = {r.doc_id: max(range(4), key=lambda s: r.h[s]) for r in tried}
    members = defaultdict(list)
    for r in sorted(tried, key=lambda r: (r.doc_id, r.crc)):
        members[shard[r.doc_id]].append(r.doc_id)
    for s, own in members.items():  # one bucket for each shard
        draws = spark.range(len(own)).select(F.xxhash64(F.lit(22), F.lit(s), F.lit(0).cast("long"), F.col("id").cast("int")).alias("d")).collect()
        perm = []
        for i, r in enumerate(draws):
            j = r.d % (i + 1)
            perm.append(i)
            perm[i], perm[j] = perm[j], perm[i]
        assert {d: got[d] for d in own} == {d: (s, perm[k]) for k, d in enumerate(own)}
