"""Grace hash deduplication: small tables force spills on every level; results against a dictionary."""

from __future__ import annotations

import hashlib
import random

from tessera.llm.exact_dedup import ENTRY, TABLE_BYTES, TextTable, collapse, content_hash, deduplicate, grace


def test_grace_recursion(tmp_path):
    r = random.Random(5)
    texts = [f"text {r.randrange(400)} ".encode() * r.randrange(1, 4) for _ in range(3000)]
    rows = [(content_hash(t), t, i if i % 9 else None, 1) for i, t in enumerate(texts)]
    got = {}
    for t in grace(iter(rows), str(tmp_path), 0, 20 * ENTRY):
        for text, keep, n in zip(t.texts, t.keep, t.count, strict=True):
            assert text not in got
            got[text] = (keep, n)
    want = {}
    for _, t, i, _ in rows:
        keep, n = want.get(t, (None, 0))
        want[t] = (max([x for x in (keep, i) if x is not None], default=None), n + 1)
    assert got == want


def test_same_hash_other_content():
    t = TextTable()
    for text in (b"a", b"b", b"a"):
        t.add(7, text, 1, 1)
    assert t.texts == [b"a", b"b"] and t.count == [2, 1]


def test_frame(spark):
    rows = [(1, "a", "s"), (5, "a", "s"), (5, "a", "s"), (2, None, "s"), (3, "", "s"), (None, "n", "s"), (None, "n", "s"), (9, "x" * 300_000, "s"), (10, "A", "s"), (11, " a", "s")]
    got = deduplicate(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t, _ in rows:
        by.setdefault(t or "", []).append(i)
    for r in got:
        group = by[next(t or "" for i, t, _ in rows if hashlib.sha256((t or "").encode()).hexdigest() == r.text_sha256)]
        keep = max((i for i in group if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(group), r.doc_id == keep)
    assert deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_first_pass_keeps_its_budget():
    """Many short texts: the table is handed on before its objects outgrow the budget, and no text or copy is lost."""
    import pyarrow as pa

    n = 3 * TABLE_BYTES // ENTRY // 2
    batches = (pa.RecordBatch.from_arrays([pa.array(range(lo, lo + 5000)), pa.array([f"t{i % (n // 2)}" for i in range(lo, lo + 5000)])], ["doc_id", "text"]) for lo in range(0, n, 5000))
    sizes, copies, seen = [], 0, set()
    for out in collapse(batches):
        sizes.append(out.num_rows)
        copies += sum(out.column("n").to_pylist())
        seen |= set(out.column("text").to_pylist())
    assert copies == -(-n // 5000) * 5000 and len(seen) == n // 2 and sum(sizes) >= n // 2
    assert max(sizes) <= TABLE_BYTES // ENTRY
