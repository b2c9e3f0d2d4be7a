"""Crawl queries: orders are pages that link to the orders of their parts' numbers; customers crawl from their own orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crawling as C
from ..operators import documents as D
from ..sources.tables import load
from .registry import query


def _step(k: int) -> str:
    """CTEs of one depth: links of the last frontier, the first ten pages in all."""
    return f"""
near{k} as (select f.seed, b.link as url, min(row(f.place, b.rank)) as spot from front{k - 1} f join best b on b.url = f.url group by all),
fresh{k} as (select n.*, (select count(*) from v{k - 1} v where v.seed = n.seed) as used from near{k} n where not exists (select 1 from v{k - 1} v where v.seed = n.seed and v.url = n.url)),
front{k} as (select seed, url, {k} as depth, used + row_number() over (partition by seed order by spot, url) as place from fresh{k} qualify place <= 10),
v{k} as (select * from v{k - 1} union all select * from front{k})"""


_CRAWL = f"""
links as (
select 'https://h.org/' || l_orderkey as url, 'https://h.org/' || l_partkey || case when l_linenumber % 3 = 0 then '.pdf' else '' end as link, l_quantity::bigint as score,
       'Notice ' || l_linenumber || ' of ' || l_suppkey as label
from lineitem),
best as (
select url, link, row_number() over (partition by url order by score desc, link desc) as rank from (select url, link, max(score) as score from links where link not like '%.pdf' group by all) qualify rank <= 6),
front0 as (select o_custkey as seed, 'https://h.org/' || o_orderkey as url, 0 as depth, row_number() over (partition by o_custkey order by o_orderkey) as place from orders qualify place <= 10),
v0 as (select * from front0), {_step(1)}, {_step(2)}"""


def link_table(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c: F.concat(F.lit("https://h.org/"), c)
    link = F.concat(at("l_partkey"), F.when(F.col("l_linenumber") % 3 == 0, ".pdf").otherwise(""))
    label = F.format_string("Notice %d of %d", "l_linenumber", "l_suppkey")
    return load(spark, d, "lineitem").select(at("l_orderkey").alias("url"), link.alias("link"), F.col("l_quantity").cast("long").alias("score"), label.alias("label"))


def visited(spark: SparkSession, d: str) -> DataFrame:
    seeds = load(spark, d, "orders").select(F.col("o_custkey").alias("seed"), F.concat(F.lit("https://h.org/"), "o_orderkey").alias("url"), F.col("o_orderkey").alias("ord"))
    return C.crawl(seeds, link_table(spark, d).where("not link like '%.pdf'"), depth=2)


@query(f"with {_CRAWL} select seed, url, depth, place::int as place from v2")
def crawl_budget(spark: SparkSession, d: str) -> DataFrame:
    """Ten pages a customer, six links a page, two steps deep."""
    return visited(spark, d)


@query(f"""
with {_CRAWL},
d as (
select v.seed, link, place, label, case when label like '%of 7%' then -100 else 5 + (contains(lower(link || ' ' || label), 'notice'))::int
       + 4 * ((contains(lower(link || ' ' || label), 'h.org'))::int) end as score
from v2 v join links l on l.url = v.url where link like '%.pdf')
select seed, link, arg_max(label, (score, -place, -pos)) as label, max(score)::bigint as score
from (select *, row_number() over (partition by seed, link, place, score order by label) as pos from d where score > 0) group by seed, link""")
def crawl_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents on the pages visited; those of suppliers 7, 70 to 79 and so on are rejected."""
    score = F.when(F.col("label").contains("of 7"), -100).otherwise(D.document_link_score(F.col("link"), F.col("label"), ["h.org"], []))
    return C.found_documents(visited(spark, d), link_table(spark, d), score.cast("long"), F.lower("link").contains(".pdf"))


@query("""
select s_suppkey, i::int as n, replace(replace(q, '%h', 'www.' || lower(n_name) || '.org'), '%n', s_name) as query
from supplier join nation on n_nationkey = s_nationkey, (values (0, 'site:%h "%n" filetype:pdf'), (1, 'site:%h %n notification pdf'), (2, 'site:%h %n information brochure')) v(i, q)""")
def targeted_searches(spark: SparkSession, d: str) -> DataFrame:
    official = F.concat(F.lit("www."), F.lower("n_name"), F.lit(".org"))
    rows = load(spark, d, "supplier").join(load(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return C.targeted_searches(rows.withColumn("official", official), "s_suppkey", "s_name", "official")


@query("""
with r as (
select o_custkey, o_orderkey, o_orderkey % 3 as n, 'https://' || case when o_orderkey % 4 = 0 then 'other' else 'www' || o_custkey end || '.x.org/' || (o_orderkey % 5) || case when o_orderkey % 7 < 5 then '.pdf' else '.html' end as url,
       o_orderpriority || ' ' || o_orderstatus as label
from orders)
select o_custkey, url as link, arg_max(label, (length(label), -n, -o_orderkey)) as label, max(length(label)) as score
from r where o_orderkey % 4 <> 0 and url like '%.pdf' and o_orderkey % 7 < 5 group by all""")
def targeted_documents(spark: SparkSession, d: str) -> DataFrame:
    """Orders as search results for their customer's host: PDFs of the site, the longest label the best."""
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, "other").otherwise(F.concat(F.lit("www"), "o_custkey"))
    url = F.concat(F.lit("https://"), name, F.lit(".x.org/"), k % 5, F.when(k % 7 < 5, ".pdf").otherwise(".html"))
    rows = load(spark, d, "orders").select(
        "o_custkey", F.concat(F.lit("www"), "o_custkey", F.lit(".x.org")).alias("official"), (k % 3).alias("n"), k.alias("rank"), url.alias("url"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("content")
    )
    return C.targeted_documents(rows, "o_custkey", "official", F.length("label").cast("long"))
