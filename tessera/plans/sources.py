"""Queries on what is searched, read and shown: searches for sources, their order, addresses of documents, escaped text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compiling as K
from ..operators import documents as D
from ..sources.tables import load
from .registry import query
from .wording import _HEADINGS, pick, pick_sql


@query("""
select s_suppkey, i::int as n, s_name || ' ' || q as query
from supplier, (values (0, 'official notification'), (1, 'official website'), (2, 'notification PDF'), (3, 'recruitment notification')) v(i, q)""")
def source_searches(spark: SparkSession, d: str) -> DataFrame:
    """The searches for the sources of every supplier's name."""
    return D.source_searches(load(spark, d, "supplier"), "s_suppkey", F.concat(F.lit(" "), "s_name"))


@query("""
select o_custkey, place::int as place, o_orderkey from (
  select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey % 5 desc, case when o_orderkey % 3 = 0 then 0 else o_totalprice end desc, 'u' || o_orderkey) as place from orders)
where place <= 12""")
def best_sources(spark: SparkSession, d: str) -> DataFrame:
    """Orders as search results of their customer: own score first, the provider's (not always there) among equals."""
    k = F.col("o_orderkey")
    rows = load(spark, d, "orders").select("o_custkey", k, F.concat(F.lit("u"), k).alias("url"), F.when(k % 3 != 0, F.col("o_totalprice")).alias("score"))
    return D.best_sources_of(rows, "o_custkey", k % 5).select("o_custkey", "place", "o_orderkey")


@query("""
select page_id, contains(lower(case when page_id % 3 = 0 then 'Application/PDF; q=1' when page_id % 3 = 1 then 'text/html' end), 'application/pdf') is true
       or ends_with(lower(url || case when page_id % 4 = 0 then '.PDF' else '' end), '.pdf') as pdf from pages""")
def pdf_addresses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    kind = F.when(k % 3 == 0, "Application/PDF; q=1").when(k % 3 == 1, "text/html")
    url = F.concat("url", F.when(k % 4 == 0, ".PDF").otherwise(""))
    return load(spark, d, "pages").select("page_id", T.is_pdf_address(kind, url).alias("pdf"))


@query("""select page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as shown from pages""")
def escaped_pages(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", T.escape_html(F.col("html")).alias("shown"))


@query("""
with s as (select o_orderkey, case when o_orderkey % 5 <> 0 then ' ' || o_orderpriority end as name, case when o_orderkey % 4 <> 0 then o_orderstatus else ' ' end as body,
                  o_orderdate::date as opens, o_orderdate::date + (o_orderkey % 9)::int - 3 as closes, o_orderdate::date + (o_orderkey % 7)::int - 4 as released from orders)
select o_orderkey, array_to_string(list_filter([case when name is null then 'missing-name' end, case when trim(body) = '' then 'missing-body' end, case when closes < opens then 'closes-before-it-opens' end,
  case when released > opens then 'released-after-opening' end], lambda x: x is not null), ',') as issues from s""")
def information_issues(spark: SparkSession, d: str) -> DataFrame:
    k, opens = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    day = lambda n, less: F.date_add(opens, (k % n).cast("int") - less)
    name = F.when(k % 5 != 0, F.concat(F.lit(" "), "o_orderpriority"))
    body = F.when(k % 4 != 0, F.col("o_orderstatus")).otherwise(" ")
    return load(spark, d, "orders").select("o_orderkey", F.array_join(K.information_issues(name, body, opens, day(9, 3), day(7, 4)), ",").alias("issues"))


@query(f"""
with s as (select o_orderkey, {pick_sql([h for h, _ in _HEADINGS], "o_orderkey")} as title, {pick_sql([a for _, a in _HEADINGS], "o_orderkey")} as answer, (o_orderkey % 2 + 1)::int as level, (o_orderkey % 10) / 10.0 as c from orders)
select o_orderkey, case when answer = 'always' then true else answer <> 'numbered' and level = 1 and c < 0.7 end as fragment from s""")
def heading_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of forms and tables among detected headings, by their wording or as unsure headings of the first level."""
    k = F.col("o_orderkey")
    found = D.is_fragment(pick([h for h, _ in _HEADINGS], "o_orderkey"), (k % 2 + 1).cast("int"), (k % 10) / 10.0)
    return load(spark, d, "orders").select("o_orderkey", found.alias("fragment"))


#: Sentences and the levels of education that they ask for.
_ASKING = [
    ("Candidates must have a Bachelor degree in any subject.", ["Bachelor's"]), ("Eligibility: 12th pass or diploma holders.", []), ("Applicants who have completed 10th or less may apply.", ["10th"]),
    ("A master or doctoral degree is required to apply.", ["Master's", "PhD"]), ("The last date is near, no degree is needed.", []), ("Qualified in senior secondary or diploma; write.", ["12th / Senior Secondary", "Diploma"]), ("must have it", []),
]
_ANSWERS = ", ".join("('" + s.replace("'", "''") + "', '" + level.replace("'", "''") + "')" for s, levels in _ASKING for level in levels)


@query(f"""
with s as (select c_custkey, {pick_sql([s for s, _ in _ASKING], "c_custkey")} as a, {pick_sql([s for s, _ in _ASKING], "c_custkey", 7)} as b from customer),
p as (select c_custkey, 0 as passage, a as sentence from s union all select c_custkey, 1, b from s),
f as (select c_custkey, v.level, case when v.sentence like 'Qualified%' then 'Qualified in senior secondary or diploma;' else v.sentence end as quote, min(passage)::int as passage
      from p join (values {_ANSWERS}) v(sentence, level) on v.sentence = p.sentence group by all)
select * from f""")
def recovered_qualifications(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    both = F.array(F.struct(F.lit(0).alias("passage"), pick([s for s, _ in _ASKING], "c_custkey").alias("text")), F.struct(F.lit(1).alias("passage"), pick([s for s, _ in _ASKING], "c_custkey", 7).alias("text")))
    passages = load(spark, d, "customer").select(key, F.inline(both))
    return K.recovered_qualifications(passages, "c_custkey", "passage", "text").select("c_custkey", "level", "quote", "passage")


@query("""
with s as (select o_orderkey as k, o_orderdate::date as day from orders),
v as (select k, day + (k % 5)::int as opens, case when k % 11 <> 0 then day + 3 end as closes, day + (k % 7)::int as s1, day + (k % 6)::int as e1, k % 3 > 0 as two, day + 1 as s2, day + 2 as e2, 20 + (k % 9)::int as lo, case when k % 4 <> 0 then 24 end as hi from s)
select k as o_orderkey, array_to_string(list_filter([case when opens > closes then 'Application start date is after application end date.' end, case when s1 > e1 then 'Exam start date is after exam end date.' end,
  case when closes > case when two then least(s1, s2) else s1 end then 'Application end date is after the examination begins.' end, case when lo > hi then 'Minimum age is greater than maximum age.' end], lambda x: x is not null), '|') as errors
from v""")
def date_and_age_errors(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    on = lambda n: F.date_add(day, (k % n).cast("int"))
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    first, second = span(on(7), on(6)), span(F.date_add(day, 1), F.date_add(day, 2))
    ranges = F.when(k % 3 > 0, F.array(first, second)).otherwise(F.array(first))
    errors = K.date_and_age_errors(on(5), F.when(k % 11 != 0, F.date_add(day, 3)), ranges, 20 + k % 9, F.when(k % 4 != 0, 24))
    return load(spark, d, "orders").select("o_orderkey", F.array_join(errors, "|").alias("errors"))


@query("""
with f as (select o_orderkey, o_orderdate::date as day, o_orderkey % 5 = 0 as bad_day, o_orderkey % 7 = 0 as bad_rule from orders)
select o_orderkey, case when not bad_day and not bad_rule then strftime(day, '%Y-%m-%d') end as opens, case when not bad_day and not bad_rule then 'CGPA >= 7' end as rule,
       array_to_string(list_filter([case when bad_rule then 'Age must be represented as Date of Birth' end, case when bad_day then 'Unable to normalize date: opens' end], lambda x: x is not null), '|') as why
from f""")
def normal_extractions(spark: SparkSession, d: str) -> DataFrame:
    """A notice for each order with a day and a rule, some unreadable: taken whole or refused whole."""
    k = F.col("o_orderkey")
    rows = load(spark, d, "orders")
    opens = F.when(k % 5 == 0, "some day").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    rules = rows.select(k, F.when(k % 7 == 0, " Age ").otherwise("cgpa").alias("attribute"), F.lit("at least").alias("operator"), F.lit(" 7 ").alias("value"))
    info, leaves, refused = K.normal_extractions(rows.select(k, opens.alias("opens")), rules, "o_orderkey", ["opens"])
    told = leaves.select("o_orderkey", F.concat_ws(" ", "attribute", "operator", "value").alias("rule"))
    why = refused.groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_list("why")), "|").alias("why"))
    out = rows.select(k).join(info, "o_orderkey", "left").join(told, "o_orderkey", "left").join(why, "o_orderkey", "left")
    return out.select("o_orderkey", "opens", "rule", F.coalesce("why", F.lit("")).alias("why"))
