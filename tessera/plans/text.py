"""Queries on strings, dates and numbers. Where the sample tables lack the words, literal samples stand beside what they must give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numbers as N
from ..functions import text as T
from ..sources.tables import load
from .registry import query


def sampled(spark: SparkSession, d: str, samples: list[str]) -> DataFrame:
    """Every customer with one of the samples."""
    picked = F.element_at(F.array(*map(F.lit, samples)), (F.pmod("c_custkey", F.lit(len(samples))) + 1).cast("int"))
    return load(spark, d, "customer").select("c_custkey", picked.alias("s"))


def expected(samples: list[str], results: list[str], names: str) -> str:
    """SQL that gives every customer the result that belongs to its sample."""
    rows = ", ".join(f"({i}, {r})" for i, r in enumerate(results))
    return f"select c_custkey, {names} from customer join (values {rows}) v(i, {names}) on c_custkey % {len(samples)} = i"


_NAMES = ["B.Tech.", "Bachelor's  Degree", "MBA", "12th", "Indian", "  Computer   Science ", "Ph.D.", "senior secondary course"]
_CANON = ["bachelor's", "bachelor's", "master's", "12th / senior secondary", "india", "computer science", "phd", "12th / senior secondary"]


@query(expected(_NAMES, ["'" + x.replace("'", "''") + "'" for x in _CANON], "canon"))
def canon_text(spark: SparkSession, d: str) -> DataFrame:
    return sampled(spark, d, _NAMES).select("c_custkey", T.canonical(F.col("s")).alias("canon"))


@query(expected(_NAMES, ["4", "4", "5", "2", "null", "null", "6", "2"], "rank"))
def level_ranks(spark: SparkSession, d: str) -> DataFrame:
    return sampled(spark, d, _NAMES).select("c_custkey", T.level_rank(F.col("s")).cast("int").alias("rank"))


@query(r"""
with w as (select p_partkey, list_filter(regexp_extract_all(p_name, '[A-Za-z]+'), lambda x: lower(x) not in ('in','of','for','and','the','a','an','to','on')) as ws from part),
i as (select p_partkey, array_to_string(list_transform(ws, lambda x: lower(x[1])), '') as s from w)
select p_partkey, list_transform(list_filter([3, 4, 5, 6], lambda k: k <= length(s)), lambda k: s[1:k]) as acronyms from i""")
def acronyms(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", T.acronyms(F.col("p_name")).alias("acronyms"))


@query("select doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1 and x not in ('the', 'of', 'and', 'de', 'la') and not regexp_full_match(x, '(19|20)[0-9][0-9]')))) as tokens from documents")
def chat_tokens(spark: SparkSession, d: str) -> DataFrame:
    found = T.chat_tokens(F.col("text"), ("the", "of", "and", "de", "la"))
    return load(spark, d, "documents").select("doc_id", F.array_sort(found).alias("tokens"))


@query("select p_partkey, p_name from part where contains(lower(p_name || ' ' || p_type), 'an') and contains(lower(p_name || ' ' || p_type), 'e')")
def catalog_tokens(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").where(T.catalogue_match("an, e", F.concat_ws(" ", "p_name", "p_type"), F.col("p_name"))).select("p_partkey", "p_name")


@query("select o_orderkey, [strftime(o_orderdate, '%Y')] as years from orders")
def year_tokens(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("no 12005 of "), F.date_format("o_orderdate", "yyyy"), F.lit(", again "), F.date_format("o_orderdate", "yyyy"))
    return load(spark, d, "orders").select("o_orderkey", T.years(text, ("19", "20")).alias("years"))


_STYLES = ["MMMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy"]


@query("select o_orderkey, [o_orderdate::date] as days from orders")
def date_mentions(spark: SparkSession, d: str) -> DataFrame:
    styled = F.lit(None).cast("string")
    for k, style in enumerate(_STYLES):
        styled = F.when(F.col("o_orderkey") % len(_STYLES) == k, F.date_format("o_orderdate", style)).otherwise(styled)
    text = F.concat(F.lit("Portal closes (extended) on "), styled, F.lit(" at 5 pm; rule 31/02/2027 is no day."))
    return load(spark, d, "orders").select("o_orderkey", D.date_set(text).alias("days"))


_DATED = ["6th-9th March 2027", "February 6 & 7, 2027", "Sep 22 – Sep 30, 2026", "February 30, 2027", "on the 1st of August, 2025", "01/02/27"]
_DAYS = ["6 7 8 9/3/2027", "6 7/2/2027", "22 30/9/2026", "", "1/8/2025", "1/2/2027"]


def _dates_sql(text: str) -> str:
    if not text:
        return "[]::date[]"
    days, month, year = text.split("/")
    return "[" + ", ".join(f"date '{year}-{int(month):02d}-{int(x):02d}'" for x in days.split()) + "]"


@query(expected(_DATED, [_dates_sql(x) for x in _DAYS], "days"))
def date_lists(spark: SparkSession, d: str) -> DataFrame:
    return sampled(spark, d, _DATED).select("c_custkey", D.date_set(F.col("s")).alias("days"))


@query("select o_orderkey, o_orderdate::date as day from orders")
def normal_dates(spark: SparkSession, d: str) -> DataFrame:
    styled = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    return load(spark, d, "orders").select("o_orderkey", D.normal_date(styled).alias("day"))


@query("""
select o_orderkey, (o_orderdate::date - interval 31 year + interval 1 day)::date as max_30, (o_orderdate::date - interval 18 year)::date as min_18,
       (o_orderdate::date - interval 32 year + interval 1 day)::date as below_32, (o_orderdate::date - interval 22 year)::date as above_21 from orders""")
def dob_bounds(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    yes, no = F.lit(True), F.lit(False)
    b = lambda kind, n, exclusive: D.birth_bound(F.lit(kind), F.lit(n), day, exclusive)["day"]
    return load(spark, d, "orders").select("o_orderkey", b("maximum", 30, no).alias("max_30"), b("minimum", 18, no).alias("min_18"), b("maximum", 32, yes).alias("below_32"), b("minimum", 21, yes).alias("above_21"))


_WORDED = ["below 30 years", "not more than 30", "under the age of 32", "above 18 years", "at least 18"]


@query(expected(_WORDED, ["true, false", "false, false", "true, false", "false, true", "false, false"], "top, low"))
def exclusive_wording(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s")
    return sampled(spark, d, _WORDED).select("c_custkey", D.exclusive_wording(F.lit("maximum"), s).alias("top"), D.exclusive_wording(F.lit("minimum"), s).alias("low"))


@query("select o_orderkey, ceil((epoch(o_orderdate) - epoch(timestamp '1998-06-01 12:00:00')) / 86400)::bigint as days from orders")
def days_until(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("1998-06-01 12:00:00").cast("timestamp")
    return load(spark, d, "orders").select("o_orderkey", D.days_until(F.col("o_orderdate").cast("timestamp"), now).alias("days"))


@query("select doc_id, ceil(length(text) / 3.0)::bigint as tokens, ceil(length(text) / 3.0)::bigint + 8 + ceil(length(source) / 3.0)::bigint + 8 + 1 + 500 as cost from documents")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    cost = N.request_cost(F.array("text", "source"), F.lit("{}"), F.lit(500))
    return load(spark, d, "documents").select("doc_id", N.estimated_tokens(F.col("text")).alias("tokens"), cost.cast("long").alias("cost"))


@query("select c_custkey, case when c_custkey % 2 = 0 then round(c_acctbal, 2) end as percentage, case when c_custkey % 2 = 1 then round(c_acctbal, 2) end as cgpa from customer")
def parsed_scores(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.format_string("%.2f", F.round("c_acctbal", 2)), F.when(F.col("c_custkey") % 2 == 0, "%").otherwise(""))
    return load(spark, d, "customer").select("c_custkey", F.inline(F.array(N.parsed_score(text))))


@query("select p_partkey, case when p_size % 2 = 0 then (p_size // 2)::varchar else (p_size // 2)::varchar || '.5' end as shown from part")
def shown_numbers(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", N.shown(F.col("p_size") / 2.0).alias("shown"))


@query(r"select page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) as host, regexp_matches(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '(^|\.)(example\.org|tionsh\.example\.net)$') as blocked from pages")
def hosts(spark: SparkSession, d: str) -> DataFrame:
    h = T.host(F.col("url"))
    return load(spark, d, "pages").select("page_id", h.alias("host"), T.host_in(h, ["example.org", "tionsh.example.net"]).alias("blocked"))


@query(r"""
with h as (select page_id, string_split(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '.') as p from pages)
select page_id, p = ['therha', 'example', 'net'] or (len(p) >= 3 and p[-3:] = ['therha', 'example', 'net']) as same from h""")
def same_site(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", T.same_site(T.host(F.col("url")), F.lit("therha.example.net")).alias("same"))


@query(r"select doc_id, case when length(text) <= 60 then text else regexp_replace(text[1:60], ' [^ ]*$', '') || '…' end as short from documents")
def shortened(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", T.shorten(F.col("text"), 60).alias("short"))


@query("""
with f as (select doc_id, text, position(text[300:339] in text) as at_ from documents)
select doc_id, case when at_ > 51 then text[at_ - 50:at_ + 49] else text[1:100] end as part from f""")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Every document, around where its characters from 300 on stand first."""
    docs = load(spark, d, "documents").withColumn("q", F.substring("text", 300, 60))
    return docs.select("doc_id", T.excerpt(F.col("text"), F.col("q"), 100).alias("part"))


@query("select c_custkey, regexp_matches(c_name || '@mail.example', '^[^@ ]+@[^@ ]+\\.[^@ ]+$') as ok, nullif(trim(case when c_custkey % 3 = 0 then '  ' else c_mktsegment end), '') as clean from customer")
def address_checks(spark: SparkSession, d: str) -> DataFrame:
    blank: Column = F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_mktsegment"))
    return load(spark, d, "customer").select("c_custkey", T.deliverable(F.concat("c_name", F.lit("@mail.example"))).alias("ok"), T.blank_to_null(blank).alias("clean"))


@query("select page_id, regexp_replace(lower(trim(regexp_replace(url, '\\s+', ' ', 'g'))), '[0-9]+', '#', 'g') as margin from pages")
def margin_keys(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", T.margin_key(F.col("url")).alias("margin"))


@query("select n_nationkey, '{\"name\": \"' || n_name || '\"}' as json from nation")
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit('<think>{"name": "?"}</think>\n```json\n{"name": "'), "n_name", F.lit('"}\n``` done'))
    return load(spark, d, "nation").select("n_nationkey", T.model_json(answer).alias("json"))


@query("select doc_id, sha256(text) as sha256, octet_length(encode(text)) as n_bytes from documents")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("""
with s as (select o_orderkey, o_orderdate::date as day, o_orderkey % 6 as m, (o_orderkey % 24)::int as h, (o_orderkey % 60)::int as i from orders)
select o_orderkey, case when m = 4 then null else strftime(day, '%Y-%m-%d') end as date,
       case m when 0 then lpad(h::varchar, 2, '0') || ':' || lpad(i::varchar, 2, '0') when 1 then '24:00' when 2 then lpad((h % 12 + case when h % 2 = 1 then 12 else 0 end)::varchar, 2, '0') || ':00' end as time
from s""")
def moments(spark: SparkSession, d: str) -> DataFrame:
    """Order dates with a time of the day, midnight as 24:00, half days, unreadable minutes, with AM behind minutes, without."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    h, i = (k % 24).cast("int"), (k % 60).cast("int")
    half = F.format_string("%s, up to %d %s", F.date_format(day, "MMMM d, yyyy"), F.when(h % 12 == 0, 12).otherwise(h % 12), F.when(h % 2 == 1, "PM").otherwise("am"))
    forms = [
        F.format_string("%s at %d:%02d", F.date_format(day, "d MMMM yyyy"), h, i), F.concat(F.date_format(day, "dd/MM/yyyy"), F.lit(" till 24:00")), half,
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 7:75")), F.concat(F.date_format(day, "d MMM yyyy"), F.lit(" 10:30 AM")), F.date_format(day, "dd.MM.yyyy"),
    ]
    text = F.get(F.array(*forms), (k % 6).cast("int"))
    return load(spark, d, "orders").select("o_orderkey", D.moment(text).alias("m")).select("o_orderkey", "m.date", "m.time")


@query("""
select o_custkey, count(*) as n, string_agg(strftime(o_orderdate, '%Y-%m-%d') || ' ' || 'Order ' || o_orderkey || ' of ' || strftime(o_orderdate, '%d/%m/%Y'), '|' order by o_orderkey) as lines
from orders group by o_custkey""")
def dated_lines(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as the lines of a text, each with its date."""
    line = F.concat(F.lit(" Order "), "o_orderkey", F.lit(" of "), F.date_format("o_orderdate", "dd/MM/yyyy"))
    listed = F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line"))))
    texts = load(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n\n").alias("text"))
    found = texts.select("o_custkey", D.dated_lines(F.col("text")).alias("found"))
    joined = F.array_join(F.transform("found", lambda x: F.concat_ws(" ", x["date"], x["context"])), "|")
    return found.select("o_custkey", F.size("found").cast("long").alias("n"), joined.alias("lines"))
