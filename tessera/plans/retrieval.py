"""Retrieval and grounding queries: a source's documents are the passages of one document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compiling as C
from ..operators import extraction as X
from ..operators import retrieval as R
from ..sources.tables import load
from .registry import query

TERMS = {"tion": 1.0, "thing": 2.0, "never": 2.0, "the": 0.5, "und": 1.0, "que": 1.0}


def passages(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("source", "doc_id", "text", F.split("text", " ")[0].alias("title"))


_WEIGHTS = "t(term, weight) as (values " + ", ".join(f"('{k}', {v}::double)" for k, v in TERMS.items()) + ")"
_BM25 = f"""
{_WEIGHTS},
p as (select source, doc_id, title, text, list_concat(regexp_extract_all(lower(text), '[a-z0-9]+'), regexp_extract_all(lower(title), '[a-z0-9]+'), regexp_extract_all(lower(title), '[a-z0-9]+')) as tok from (select source, doc_id, text, string_split(text, ' ')[1] as title from documents)),
s as (select source, count(*) as n, avg(len(tok)) as mean from p group by source),
w as (select source, doc_id, len(tok) as l, unnest(tok) as term from p),
c as (select source, doc_id, l, term, count(*) as tf from w where term in (select term from t) group by all),
df as (select source, term, count(*) as df from c group by all),
bm as (select c.source, c.doc_id, sum(t.weight * ln(1 + (n - df.df + 0.5) / (df.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) as score
       from c join df using (source, term) join s using (source) join t using (term) group by all)"""


@query(f"with {_BM25} select source, doc_id, round(score, 4) as score from bm")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    found = R.bm25_scores(passages(spark, d), "source", "doc_id", "text", TERMS, "title")
    return found.withColumn("score", F.round("score", 4))


@query(f"with {_BM25} select source, doc_id, round(score, 4) as score, rank::int as rank from (select *, row_number() over (partition by source order by round(score, 4) desc, doc_id) as rank from bm) where rank <= 5")
def bm25_top(spark: SparkSession, d: str) -> DataFrame:
    """The five best passages of each source."""
    from pyspark.sql import Window

    found = R.bm25_scores(passages(spark, d), "source", "doc_id", "text", TERMS, "title").withColumn("score", F.round("score", 4))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id")))
    return ranked.where("rank <= 5").select("source", "doc_id", "score", "rank")


@query(f"""
with {_BM25},
x as (select p.source, p.doc_id, p.title, p.text, coalesce(bm.score, 0) as raw, max(coalesce(bm.score, 0)) over (partition by p.source) as top from p left join bm on bm.source = p.source and bm.doc_id = p.doc_id)
select source, doc_id, round((case when top > 0 then raw / top * 10 else 0 end + case when regexp_matches(text, '[0-9]') then 1.5 else 0 end + case when contains(lower(title), 'th') then 3 else 0 end) * case when regexp_matches(title, '^La') then 0.4 else 1 end, 4) as score from x""")
def facet_scores(spark: SparkSession, d: str) -> DataFrame:
    found = R.facet_scores(passages(spark, d), "source", "doc_id", "text", TERMS, {"[0-9]": 1.5}, "title", ["th"], "^La")
    return found.select("source", "doc_id", F.round("score", 4).alias("score"))


@query(f"""
with recursive {_BM25},
rows as (
select p.source, p.doc_id as i, p.title as s, round(coalesce(bm.score, 0), 4) as score, ceil(length(p.text) / 3.0)::bigint + 4 as cost,
       lag(p.doc_id) over w as before, lead(p.doc_id) over w as after, count(*) over (partition by p.source, p.doc_id) as copies
from p left join bm on bm.source = p.source and bm.doc_id = p.doc_id window w as (partition by p.source order by p.doc_id)),
ranked as (select *, row_number() over (partition by source order by score desc, i) as rn, max(score) over (partition by source) as top from rows),
good as (select source, i, cost, row_number() over (partition by source order by rn) as rn from ranked where top > 0 and score >= top * 0.25),
buy as (
select source, 0::bigint as rn, 0::bigint as used, []::bigint[] as taken from (select distinct source from good)
union all
select b.source, g.rn, case when used + cost <= 2000 then used + cost else used end, case when used + cost <= 2000 then list_append(taken, i) else taken end
from buy b join good g on g.source = b.source and g.rn = b.rn + 1),
bought as (select source, arg_max(used, rn) as used, arg_max(taken, rn) as taken from buy group by source),
k as (select source, unnest(taken) as i, unnest(range(len(taken))) as k from bought),
asked as (
select k.source, r.s, k * 2 as o, r.before as i from k join rows r on r.source = k.source and r.i = k.i
union all select k.source, r.s, k * 2 + 1, r.after from k join rows r on r.source = k.source and r.i = k.i),
near as (select a.source, r.i, r.cost, row_number() over (partition by a.source order by o) as rn from asked a join rows r on r.source = a.source and r.i = a.i and r.s = a.s and r.score > 0),
more as (
select source, 0::bigint as rn, used, taken from bought
union all
select m.source, n.rn, case when used + cost <= 2000 and not list_contains(taken, i) then used + cost else used end,
       case when used + cost <= 2000 and not list_contains(taken, i) then list_append(taken, i) else taken end
from more m join near n on n.source = m.source and n.rn = m.rn + 1),
whole as (select source, unnest(arg_max(taken, rn)) as i from more group by source)
select w.source, w.i as doc_id, r.cost as tokens from whole w join rows r on r.source = w.source and r.i = w.i""")
def pack_budget(spark: SparkSession, d: str) -> DataFrame:
    """Greedy packs of 2,000 tokens a source."""
    p = passages(spark, d)
    scored = p.join(R.bm25_scores(p, "source", "doc_id", "text", TERMS, "title"), ["source", "doc_id"], "left").fillna(0.0, ["score"])
    return R.pack(scored.withColumn("score", F.round("score", 4)), "source", "doc_id", "title", "text", 2000)


@query(r"""
with g as (select doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) as p, text from documents),
q as (select doc_id, k, trim(regexp_replace(lower(quote), '[^\p{L}\p{N}_]+', ' ', 'g')) as q from (
  select doc_id, 0::bigint as k, substr(text, 101, 80) as quote from documents
  union all select doc_id, 1, array_to_string(list_filter(regexp_extract_all(text, '\S+'), lambda w, i: i <= 12 and i % 9 <> 0), ' ') from documents)),
qw as (select *, list_distinct(regexp_extract_all(q, '[\p{L}\p{N}_]+')) as w from q where length(q) >= 4),
f as (select qw.doc_id, k, contains(' ' || p || ' ', q) as exact, len(w) as n, len(list_intersect(w, regexp_extract_all(p, '[\p{L}\p{N}_]+')))::double / len(w) as ratio from qw join g using (doc_id))
select doc_id, k as quote_id, exact, round(ratio, 4) as ratio from f where exact or (n >= 3 and ratio >= 0.85)""")
def quote_locate(spark: SparkSession, d: str) -> DataFrame:
    """In every document: a quote out of its own text, and its first words without the ninth."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    own = docs.select("doc_id", F.lit(0).cast("long").alias("quote_id"), F.substring("text", 101, 80).alias("quote"))
    first = F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 1, 12)
    other = docs.select("doc_id", F.lit(1).cast("long").alias("quote_id"), F.array_join(F.filter(first, lambda w, i: i != 8), " ").alias("quote"))
    found = R.locate_quotes(own.unionByName(other), docs.withColumn("passage", F.lit(0).cast("long")), "quote_id", "quote", "doc_id", "passage", "text")
    return found.select("doc_id", "quote_id", "exact", F.round("ratio", 4).alias("ratio"))


@query(r"""
with g as (select doc_id, p, regexp_extract_all(p, '[\p{L}\p{N}_]+') as pw from (select doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) as p from documents)),
q as (select item_id, q, list_distinct(regexp_extract_all(q, '[\p{L}\p{N}_]+')) as w from (select item_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) as q from benchmark) where length(q) >= 4),
f as (select doc_id, item_id, contains(' ' || p || ' ', q) as exact, len(w) as n, len(list_intersect(w, pw))::double / len(w) as ratio from q, g)
select doc_id, item_id as quote_id, exact, round(ratio, 4) as ratio from f where exact or (n >= 3 and ratio >= 0.85)""")
def quote_locate_all(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item in every document."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    items = load(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    pairs = R.quote_candidates(items, docs, "quote_id", "quote", "doc_id", "text")
    found = R.locate_quotes(pairs, docs.withColumn("passage", F.lit(0).cast("long")), "quote_id", "quote", "doc_id", "passage", "text")
    return found.select("doc_id", "quote_id", "exact", F.round("ratio", 4).alias("ratio"))


@query("""
with recursive l as (select doc_id, rtrim(unnest(string_split(text, chr(10)))) as line, unnest(range(len(string_split(text, chr(10))))) as k from documents),
n as (select doc_id, line, row_number() over (partition by doc_id order by k) as rn from l where trim(line) <> ''),
walk as (
select doc_id, 0::bigint as rn, 0::bigint as part, 0::bigint as size from (select distinct doc_id from n)
union all
select w.doc_id, n.rn, case when size + length(line) > 1400 and size > 0 then part + 1 else part end, case when size + length(line) > 1400 and size > 0 then 0 else size end + length(line) + 1
from walk w join n on n.doc_id = w.doc_id and n.rn = w.rn + 1)
select n.doc_id, w.part as passage, 'Document' as section, trim(string_agg(line, chr(10) order by n.rn)) as text from n join walk w on w.doc_id = n.doc_id and w.rn = n.rn group by n.doc_id, w.part""")
def passages_cut(spark: SparkSession, d: str) -> DataFrame:
    """Passages of at most 1,400 characters by line; these documents have no headings, so that is one section each."""
    docs = load(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    return R.section_passages(docs, "doc_id", "page", "text").select("doc_id", "passage", "section", "text")


@query("""
with f as (select o_orderkey, o_orderdate::date as day, o_orderkey % 3 as m from orders)
select o_orderkey, case m when 0 then day when 1 then null else day + 1 end as start_day, m = 2 as swapped, m <> 1 as grounded, m = 1 as unreadable
from f""")
def compiled_dates(spark: SparkSession, d: str) -> DataFrame:
    """Order dates written three ways: plainly, unreadably, and with start and end swapped; grounded in a text that names them."""
    day, m = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 3
    start = F.when(m == 0, F.date_format(day, "d MMMM yyyy")).when(m == 1, "soon").otherwise(F.date_format(F.date_add(day, 3), "dd/MM/yyyy"))
    end = F.when(m == 2, F.date_format(F.date_add(day, 1), "yyyy-MM-dd"))
    text = F.concat_ws(" ", F.lit("dates:"), F.date_format(day, "yyyy-MM-dd"), F.date_format(F.date_add(day, 3), "d MMMM yyyy"), F.date_format(F.date_add(day, 1), "d MMMM yyyy"))
    facts = load(spark, d, "orders").select("o_orderkey", start.alias("start"), end.alias("end"), text.alias("text"))
    out = C.compile_dates(facts, "o_orderkey", "start", "end", F.col("text"))
    return out.select("o_orderkey", "start_day", "swapped", "grounded", "unreadable")


@query("""
with f as (select c_custkey as notice, c_custkey % 4 as m, 18 + (c_custkey % 5)::int as lo, 30 + (c_custkey % 7)::int as hi, date '2026-08-01' as at_ from customer)
select notice, 1 as place, 'Date of Birth' as attribute, '<=' as operator, (at_ - to_years(lo))::date::varchar as value from f
union all select notice, 1, 'Date of Birth', '>=', ((at_ - to_years(hi + 1))::date + 1)::varchar from f where m <> 1
union all select notice, 1, 'Percentage', '>=', '60' from f where m = 2
union all select notice, 2, 'Qualification', '=', v from f, (values ('Bachelor''s'), ('Master''s'), ('PhD')) q(v) where m = 0
union all select notice, 2, 'Qualification', '=', 'Diploma' from f where m = 3
union all select notice, 3, 'Nationality', '=', v from f, (values ('india'), ('nepal')) q(v)""")
def compiled_rules(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a notice as a rule tree: an AND root of limits, an OR of levels, an OR of countries."""
    m = F.col("c_custkey") % 4
    facts = load(spark, d, "customer").select(
        F.col("c_custkey").alias("notice"),
        F.lit("2026-08-01").cast("date").alias("as_of"),
        (F.lit(18) + F.col("c_custkey") % 5).cast("int").alias("minimum_age"),
        F.when(m != 1, F.lit(30) + F.col("c_custkey") % 7).cast("int").alias("maximum_age"),
        F.lit(False).alias("exclusive"),
        F.when(m == 0, F.array(F.lit("B.Tech."))).when(m == 3, F.array(F.lit("Diploma"))).otherwise(F.array().cast("array<string>")).alias("levels"),
        (m == 0).alias("or_higher"),
        F.array(F.lit("citizen of India"), F.lit("Nepali"), F.lit("Indian")).alias("countries"),
        F.lit(None).cast("double").alias("cgpa"),
        F.when(m == 2, 60.0).alias("percentage"),
    )
    groups, rules = C.compile_eligibility(facts)
    return rules.join(groups.select("group_id", "notice", F.col("group_number").alias("place")), "group_id").select("notice", "place", "attribute", "operator", "value")


def dates_of(context: DataFrame) -> DataFrame:
    """In a model's place: a fact for each order named in the context; some without a readable day, some with a quote that the
    document does not have."""
    lines = context.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    rows = lines.select("doc_id", "line", F.regexp_extract("line", r"^Order (\d+) ", 1).try_cast("long").alias("fact_id"), F.regexp_extract("line", r"closes on (.*)\.$", 1).alias("day")).where("fact_id is not null")
    start = F.when(F.col("fact_id") % 11 == 0, "soon").otherwise(F.col("day"))
    quote = F.when(F.col("fact_id") % 10 == 0, "what nobody wrote about this order").otherwise(F.col("line"))
    return rows.select("doc_id", "fact_id", start.alias("start"), F.lit(None).cast("string").alias("end"), quote.alias("quote"))


@query("""
select o_custkey as doc_id, o_orderkey as fact_id, case when o_orderkey % 11 <> 0 then o_orderdate::date end as start_day, o_orderkey % 11 <> 0 as grounded, o_orderkey % 10 <> 0 as located,
       array_to_string(list_filter([case when o_orderkey % 11 = 0 then 'unreadable-date' end, case when o_orderkey % 10 = 0 then 'quote-not-found' end], lambda x: x is not null), ',') as issues
from orders""")
def extracted_dates(spark: SparkSession, d: str) -> DataFrame:
    """Whole extraction over a document for each customer: passages by heading, a pack, facts, places of quotes, dates, issues."""
    line = F.concat(F.lit("Order "), "o_orderkey", F.lit(" closes on "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit("."))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]), "\n")
    docs = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat(F.lit("# About\nnothing that matters here\n# Dates\n"), listed).alias("text"))
    found = X.extract(docs, dates_of, {"closes": 2.0, "order": 1.0})
    return found.select("doc_id", "fact_id", "start_day", "grounded", F.col("passage").isNotNull().alias("located"), F.array_join("issues", ",").alias("issues"))
