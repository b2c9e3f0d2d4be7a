"""Crawls with budgets over a link table, breadth first for all seeds at once, and the documents found on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import host, same_site
from ..sources.tables import materialise

# The searches for a document on an official host.
SEARCHES = ('site:%1$s "%2$s" filetype:pdf', "site:%1$s %2$s notification pdf", "site:%1$s %2$s information brochure")


def crawl(seeds: DataFrame, links: DataFrame, depth: int = 1, pages: int = 10, follow: int = 6) -> DataFrame:
    """(seed, url, depth, place): the pages that a crawl of each seed visits, in the order in which it does.

    seeds: seed, url, ord (the start addresses in order); links: url, link, score. From a page the `follow` best links go on,
    by score, then address, both from the largest; a page less deep comes before a deeper one, of one depth those of earlier
    pages first, then better links. No page is visited twice for a seed, and no seed visits more than `pages`, whether or not
    a page has links. Each depth is one join of the frontier with the link table, an anti-join with what was visited, and a
    written table; a frontier has `pages` rows a seed at most. Null addresses are none; equal links count once, at their best
    score (null: least)."""
    known = links.where("url is not null and link is not null").groupBy("url", "link").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("url").orderBy(F.col("score").desc_nulls_last(), F.desc("link")))
    best = materialise(known.withColumn("rank", rank).where(F.col("rank") <= follow).select("url", "link", "rank"), "links")
    near = seeds.where("url is not null").groupBy("seed", "url").agg(F.min(F.struct(F.col("ord").cast("long"), F.lit(0))).alias("at"))
    visited: DataFrame | None = None
    for k in range(depth + 1):
        at = F.row_number().over(Window.partitionBy("seed").orderBy("at", "url"))
        if visited is None:
            front = near.withColumn("place", at)
        else:
            used = visited.groupBy("seed").agg(F.count("*").alias("used"))
            fresh = near.join(visited, ["seed", "url"], "left_anti").join(used, "seed")
            front = fresh.withColumn("place", F.col("used") + at)
        front = materialise(front.where(F.col("place") <= pages).select("seed", "url", F.lit(k).alias("depth"), F.col("place").cast("int").alias("place")), "front")
        visited = front if visited is None else visited.unionByName(front)
        if front.isEmpty():
            break
        near = front.join(best, "url").groupBy("seed", F.col("link").alias("url")).agg(F.min(F.struct(F.col("place").cast("long"), "rank")).alias("at"))
    return visited


def found_documents(visited: DataFrame, links: DataFrame, score: Column, is_document: Column) -> DataFrame:
    """(seed, link, label, score): documents among the links of the pages that each seed visited (links: url, link, label), of
    each the best score with its label, scores of 0 and less left out; score and is_document are worked out of the links'
    columns. Of equal scores the first page's label, of one page's the least."""
    rows = visited.join(links.where(is_document).withColumn("score", score), "url").where("score > 0")
    best = F.max_by(F.struct("label", "score"), F.struct("score", -F.col("place"))).alias("best")
    one = rows.groupBy("seed", "link", "place", "score").agg(F.min("label").alias("label"))
    return one.groupBy("seed", "link").agg(best).select("seed", "link", "best.label", "best.score")


def targeted_searches(exams: DataFrame, key: str, name: str, official: str) -> DataFrame:
    """(key, n, query): the searches for an exam's document on its official host."""
    queries = F.array(*[F.format_string(q, F.col(official), F.col(name)) for q in SEARCHES])
    return exams.select(key, F.posexplode(queries).alias("n", "query"))


def targeted_documents(results: DataFrame, key: str, official: str, score: Column) -> DataFrame:
    """(key, link, label, score) of the results (key, the official host, query number n, rank, url, title, content) that are
    PDFs on the official site with a score above 0; of each address the best score, of equal ones the earliest result."""
    label = F.trim(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    rows = results.where(F.lower("url").contains(".pdf") & same_site(host(F.col("url")), F.lower(official)))
    rows = rows.withColumn("label", label).withColumn("score", score).where("score > 0")
    best = F.max_by(F.struct("label", "score"), F.struct("score", -F.col("n"), -F.col("rank"))).alias("best")
    return rows.groupBy(key, F.col("url").alias("link")).agg(best).select(key, "link", "best.label", "best.score")
