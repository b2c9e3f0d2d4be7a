"""Crawls with budgets against a queue for each seed; documents found on the way and by search."""

from __future__ import annotations

import random
from collections import deque

from pyspark.sql import functions as F

from tessera.operators import crawling as C


def plain_crawl(starts, links, depth, pages, follow):
    queue, visited, out = deque((u, 0) for u in starts), set(), []
    while queue and len(out) < pages:
        url, d = queue.popleft()
        if url in visited or d > depth:
            continue
        visited.add(url)
        out.append((url, d, len(out) + 1))
        if d < depth:
            best = {}
            for link, score in links.get(url, ()):
                best[link] = max(score, best.get(link, score))
            for link, _ in sorted(best.items(), key=lambda x: (x[1], x[0]), reverse=True)[:follow]:
                queue.append((link, d + 1))
    return out


def test_crawl(spark):
    r = random.Random(3)
    urls = [f"https://h.org/{i}" for i in range(60)]
    links = {u: [(r.choice(urls), r.randrange(5)) for _ in range(r.randrange(12))] for u in urls}
    seeds = {s: [r.choice(urls) for _ in range(r.randrange(1, 6))] for s in range(25)} | {99: ["https://h.org/unknown"]}
    table = spark.createDataFrame([(u, link, score) for u, own in links.items() for link, score in own] + [(None, "x", 1), ("x", None, 1)], "url string, link string, score long").repartition(5)
    start = spark.createDataFrame([(s, u, i) for s, own in seeds.items() for i, u in enumerate(own)], "seed long, url string, ord int").repartition(3)
    for limits in ((1, 10, 6), (3, 10, 2), (0, 2, 6), (4, 1000, 100)):
        got = {}
        for x in C.crawl(start, table, *limits).collect():
            got.setdefault(x.seed, []).append((x.url, x.depth, x.place))
        assert {s: sorted(x, key=lambda y: y[2]) for s, x in got.items()} == {s: plain_crawl(own, links, *limits) for s, own in seeds.items()}
    assert C.crawl(start.limit(0), table).count() == 0


def test_documents(spark):
    visited = spark.createDataFrame([(1, "a", 0, 1), (1, "b", 1, 2), (2, "b", 0, 1)], "seed long, url string, depth int, place int")
    links = spark.createDataFrame([("a", "x.pdf", "one"), ("b", "x.pdf", "longer"), ("b", "y.PDF", "no"), ("b", "z", "page"), ("c", "q.pdf", "unseen")], "url string, link string, label string")
    got = C.found_documents(visited, links, F.length("label") - 2, F.lower("link").contains(".pdf"))
    assert sorted(map(tuple, got.collect())) == [(1, "x.pdf", "longer", 4), (2, "x.pdf", "longer", 4)]


def test_targeted(spark):
    exams = spark.createDataFrame([(1, "GATE 2027", "gate.ac.in")], "id long, name string, host string")
    assert [tuple(x) for x in C.targeted_searches(exams, "id", "name", "host").orderBy("n").collect()] == [
        (1, 0, 'site:gate.ac.in "GATE 2027" filetype:pdf'), (1, 1, "site:gate.ac.in GATE 2027 notification pdf"), (1, 2, "site:gate.ac.in GATE 2027 information brochure"),
    ]
    rows = [(1, "gate.ac.in", 0, 0, "https://gate.ac.in/a.PDF?x", " Brochure ", None), (1, "gate.ac.in", 1, 0, "https://gate.ac.in/a.PDF?x", "Brochure", "x"), (1, "gate.ac.in", 0, 1, "https://other.org/a.pdf", "t", "c"), (1, "gate.ac.in", 0, 2, "https://gate.ac.in/page", "t", "c"), (1, "gate.ac.in", 0, 3, None, "t", "c")]
    results = spark.createDataFrame(rows, "id long, host string, n int, rank int, url string, title string, content string")
    got = C.targeted_documents(results, "id", "host", F.length("label"))
    assert [tuple(x) for x in got.collect()] == [(1, "https://gate.ac.in/a.PDF?x", "Brochure x", 10)]
