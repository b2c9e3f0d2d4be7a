"""Pigeonhole edit matching against a plain edit-distance table."""

from __future__ import annotations

import random

from tessera.llm.decontamination import decontaminate, distance, pieces, plain

DOCS = "doc_id long, text string, errors string"


def table_distance(item: str, text: str) -> int:
    last = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        last = row
    return min(last)


def test_distance():
    r = random.Random(1)
    for _ in range(300):
        item = "".join(r.choice("ab c") for _ in range(r.randrange(1, 80)))
        text = "".join(r.choice("ab c") for _ in range(r.randrange(0, 90)))
        want = table_distance(item, text)
        for most in (0, 2, 5):
            if len(item) > most:
                assert distance(item, text, most) == (want if want <= most else None)


def test_pieces_make_up_the_item():
    for n in (1, 5, 60):
        item = "x" * n
        assert "".join(p for _, p in pieces(item, 3)) == item and len(pieces(item, 3)) == min(4, n)


def corpus(seed: int):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8)))
    items = {i: " ".join(word() for _ in range(r.choice([3, 12, 30]))) for i in range(8)}
    docs = {}
    for i in range(60):
        t = list(items[i % 8])
        for _ in range(r.randrange(0, 10)):  # edits on both sides of the budget
            k = r.randrange(len(t))
            t[k : k + 1] = r.choice([[], ["z"], [t[k], "z"]])
        docs[i] = " ".join(word() for _ in range(20)) + " " + "".join(t).upper() + "\n\t" + " ".join(word() for _ in range(5))
    return items, docs | {100: None, 101: "", 102: "abc " * 50_000}


def test_equals_all_pairs(spark):
    items, docs = corpus(2)
    bench = spark.createDataFrame([*items.items(), (None, "left out"), (50, None), (51, "")], "item_id long, text string")
    found = decontaminate(spark.createDataFrame([(i, t, "x") for i, t in docs.items()], DOCS), bench)
    got = {r.doc_id: (r.contaminated, r.item_ids, r.errors) for r in found.collect()}
    for i, t in docs.items():
        near = {}
        if t and len(t) < 5000:
            near = {k: d for k, x in items.items() if (d := table_distance(plain(x), plain(t))) <= int(0.05 * len(plain(x)))}
        ids, errors = got[i][1], got[i][2]
        assert ids == sorted(near) and got[i][0] is bool(near)
        assert all(e <= int(0.05 * len(plain(items[k]))) for k, e in zip(ids, errors, strict=True))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a text", "x"), (None, "a text", "x")], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate(docs, none).collect()] == [False, False]
    assert decontaminate(docs.limit(0), spark.createDataFrame([(1, "a text")], "item_id long, text string")).count() == 0
    assert {(r.doc_id, tuple(r.item_ids)) for r in decontaminate(docs, spark.createDataFrame([(1, "A Text"), (2, "a text")], "item_id long, text string")).collect()} == {(1, (1, 2)), (None, (1, 2))}


def test_blocks_give_the_same(spark):
    """Many blocks of the benchmark, each a pass of its own, and one block: equal results; repeated items keep their ids."""
    items, docs = corpus(5)
    bench = spark.createDataFrame([*items.items(), (60, items[2]), (60, items[3]), (61, "")], "item_id long, text string")
    frame = spark.createDataFrame([(i, t, "mine") for i, t in docs.items()] + [(0, docs[0], "mine")], "doc_id long, text string, sha string").repartition(3)
    key = lambda out: sorted(((r.doc_id, r.sha, r.contaminated, tuple(r.item_ids), tuple(r.errors)) for r in out.collect()), key=str)
    one, many = decontaminate(frame, bench), decontaminate(frame, bench, block_bytes=400)
    assert one.columns == many.columns and key(one) == key(many)
    assert sum(x[2] for x in key(one)) > 10
