"""Queries on profiles, question contexts, merged extractions, JSON and recovered evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import changes as C
from ..operators import compiling as K
from ..operators import documents as P
from ..operators import extraction as X
from ..operators import merging as G
from ..operators import mutations as M
from ..operators import profiles as A
from ..operators import retrieval as V
from ..sources.tables import load
from ..streaming import state as S
from .registry import query
from .wording import people, pick, pick_sql


@query("""
select c_custkey as student_id from customer where c_custkey % 4 <> 0 or c_custkey in (select o_custkey from orders)""")
def profile_exists(spark: SparkSession, d: str) -> DataFrame:
    """Students with a date of birth (not every fourth one) or any education."""
    students, educations, _ = people(spark, d)
    students = students.withColumn("date_of_birth", F.when(F.col("student_id") % 4 != 0, F.col("date_of_birth")))
    return A.with_profile(students, educations).select("student_id")


@query("""
select c_custkey as student_id, c_custkey % 4 <> 0 as has_date_of_birth, c_mktsegment <> 'BUILDING' as has_nationality, true as has_state,
       c_custkey in (select o_custkey from orders where o_orderstatus = 'O') as has_academics from customer""")
def profile_flags(spark: SparkSession, d: str) -> DataFrame:
    students, educations, _ = people(spark, d)
    students = students.withColumn("date_of_birth", F.when(F.col("student_id") % 4 != 0, F.col("date_of_birth"))).withColumn("nationality", F.when(F.col("nationality") != "BUILDING", F.col("nationality")).otherwise(""))
    return A.profile_flags(students, educations)


@query("""
select o_orderkey, case when o_orderkey % 3 = 0 then (o_orderkey % 100)::varchar || '%' when o_orderkey % 3 = 1 then (o_orderkey % 10)::varchar || '.5' end as score from orders""")
def education_scores(spark: SparkSession, d: str) -> DataFrame:
    """A percentage where there is one (every third, which has a CGPA too), else a CGPA, else nothing."""
    k = F.col("o_orderkey")
    percentage = F.when(k % 3 == 0, (k % 100).cast("double"))
    cgpa = F.when(k % 3 <= 1, (k % 10) + 0.5)
    return load(spark, d, "orders").select("o_orderkey", A.score_text(percentage, cgpa).alias("score"))


_QUESTION = "Please tell me about the large red BRASS things of 2027 and the PEB"
_WORDS = "['large', 'red', 'brass', 'things', 'peb']"


@query(f"""
with n as (select p_partkey, p_name, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) as own, list_filter(regexp_extract_all(p_name, '[A-Za-z]+'), lambda x: lower(x) not in ('in','of','for','and','the','a','an','to','on')) as ws,
  len(list_intersect({_WORDS}, regexp_extract_all(lower(p_type), '[a-z0-9]+'))) > 0 as told from part),
i as (select *, array_to_string(list_transform(ws, lambda x: lower(x[1])), '') as s from n),
v as (select *, len(list_filter({_WORDS}, lambda w: list_contains(own, w) or list_contains(list_transform(list_filter([3, 4, 5, 6], lambda k: k <= length(s)), lambda k: s[1:k]), w))) as o from i)
select p_partkey, p_name, (case when o > 0 then o else 1 end)::bigint as overlap from v where o > 0 or told order by overlap desc, p_name, p_partkey limit 3""")
def relevant_items(spark: SparkSession, d: str) -> DataFrame:
    """The three parts that share the most words (or an acronym) with a question."""
    return A.relevant(load(spark, d, "part"), "p_partkey", "p_name", "p_type", _QUESTION)


@query("""
with n as (select count(*) as c from supplier), f as (select s_name, s_acctbal, row_number() over (order by s_name) as r from supplier)
select 0 as place, 'EXAMS (' || c || ' total):' as line from n
union all select r::int, '- ' || s_name || case when s_acctbal > 0 then ' (details available)' else ' (pending review)' end from f where r <= 5
union all select 6, '- ...and ' || (c - 5) || ' more' from n where c > 5""")
def listed_items(spark: SparkSession, d: str) -> DataFrame:
    return A.listed(load(spark, d, "supplier"), "s_name", F.col("s_acctbal") > 0, 5)


@query("""
select o_orderkey, array_to_string(list_filter(['Type: ' || o_orderstatus, case when o_orderkey % 2 = 0 then 'Starts: ' || strftime(o_orderdate, '%Y-%m-%d') end], lambda x: x is not null), chr(10)) as facts from orders""")
def fact_lines(spark: SparkSession, d: str) -> DataFrame:
    starts = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").cast("date"))
    fields = [("Type", F.col("o_orderstatus")), ("Starts", starts), ("Ends", F.lit(None).cast("date")), ("Note", F.lit(""))]
    return load(spark, d, "orders").select("o_orderkey", A.fact_lines(fields).alias("facts"))


@query("""
with c as (select o_custkey, o_orderkey, case when o_orderkey % 5 <> 0 then o_orderstatus end as s, o_orderpriority as p from orders),
l as (select o_custkey, p, min(o_orderkey) as k from c group by all)
select c.o_custkey, case when count(distinct s) <= 1 then min(s) end as status, (select list(p order by k) from l where l.o_custkey = c.o_custkey) as priorities, count(distinct s) > 1 as conflicting
from c group by c.o_custkey""")
def aggregate_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as the chunks of one document: the status has to agree, priorities are listed once in order."""
    key = F.col("o_orderkey")
    chunks = load(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(key % 5 != 0, F.col("o_orderstatus")).alias("status"), F.array("o_orderpriority").alias("priorities"))
    found = G.aggregate_chunks(chunks, "o_custkey", "o_orderkey", ["status"], ["priorities"])
    return found.select("o_custkey", "status", "priorities", (F.size("conflicts") > 0).alias("conflicting"))


@query("""
select o_custkey, min(o_orderkey) as o_orderkey, o_orderstatus as status, o_orderpriority as priority from orders group by o_custkey, o_orderstatus, o_orderpriority""")
def distinct_trees(spark: SparkSession, d: str) -> DataFrame:
    """Orders as rule trees: of trees with the same JSON the first stays."""
    tree = F.struct(F.col("o_orderstatus").alias("op"), F.array(F.struct(F.col("o_orderpriority").alias("value"))).alias("rules"))
    rows = load(spark, d, "orders").select("o_custkey", "o_orderkey", tree.alias("tree"))
    found = G.distinct_trees(rows, "o_custkey", "o_orderkey", "tree")
    return found.select("o_custkey", "o_orderkey", F.col("tree.op").alias("status"), F.col("tree.rules")[0]["value"].alias("priority"))


@query("""
select o_custkey, min(o_orderdate::date) filter (o_orderkey % 2 = 0) as born_from, max(o_orderdate::date) filter (o_orderkey % 2 = 1) as born_to,
       count(distinct o_orderdate::date) filter (o_orderkey % 2 = 0) > 1 or count(distinct o_orderdate::date) filter (o_orderkey % 2 = 1) > 1 as varies from orders group by o_custkey""")
def explicit_limits(spark: SparkSession, d: str) -> DataFrame:
    limits = load(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, "from").otherwise("to").alias("bound"), F.col("o_orderdate").cast("date").alias("day"))
    return G.explicit_limits(limits, "o_custkey", "bound", "day")


@query("select o_custkey, o_orderstatus, list(o_orderpriority order by o_orderkey) as evidence from orders group by o_custkey, o_orderstatus")
def evidence_by_field(spark: SparkSession, d: str) -> DataFrame:
    found = G.by_field(load(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderkey", "o_orderpriority")
    return found.withColumn("evidence", F.col("evidence.o_orderpriority"))


@query("select o_orderkey, o_custkey, o_orderstatus, o_orderkey % 9 <> 0 as valid from orders where o_orderkey % 9 <> 0 union all select o_orderkey, null, null, false from orders where o_orderkey % 9 = 0")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON and back; every ninth text is broken and comes back as nulls."""
    rows = G.as_json(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
    rows = rows.withColumn("json", F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("x"), "json")).otherwise(F.col("json")))
    return G.from_json(rows, "o_orderkey", "json", "o_custkey long, o_orderstatus string")


@query("""
with r as (select *, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i from orders)
select o_custkey, i::int as index, '{"index":' || i || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' as json from r""")
def change_report_rows(spark: SparkSession, d: str) -> DataFrame:
    return G.report_rows(load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", ["o_orderkey"])


@query("select event_id, coalesce(json_extract_string(props, '$.k'), 'none') as k, 'none' as missing from events")
def nested_defaults(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", G.nested(F.col("props"), "$.k", "none").alias("k"), G.nested(F.col("props"), "$.a.b.c", "none").alias("missing"))


@query("select doc_id from documents")
def hashes_hold(spark: SparkSession, d: str) -> DataFrame:
    """Every document has the hash that is expected of it; one that had not would fail the job."""
    docs = load(spark, d, "documents").withColumn("expected", F.sha2(F.col("text").cast("binary"), 256))
    return G.checked_hash(docs, "text", "expected").select("doc_id")


_ROW_LINES = ["The portal opens on", "Last date of receipt", "With late fee, extended up to", "Schedule of dates", "Closing of registration"]


@query(f"""
with s as (select o_orderkey, {pick_sql(_ROW_LINES, "o_orderkey")} as a, {pick_sql(_ROW_LINES, "o_orderkey", 5)} as b, strftime(o_orderdate, '%Y-%m-%d') as day from orders),
c as (select o_orderkey, unnest([[day], [day, b], [a, day], [a, day, b], [day, b, 'end.'], [a, day, b, 'end.'], [day, b, 'end.', ''], ['']]) as l from s),
t as (select o_orderkey, array_to_string(list_filter(l, lambda x: x <> ''), ' ') as x from c)
select o_orderkey, arg_min(x, length(x)) filter (regexp_matches(lower(x), '\\b(closes|closing|close|closed|last date|deadline|end date|registration)\\b') and not regexp_matches(lower(x), '\\b(late|extended|with late fee)\\b') and x <> '') as quote
from t group by o_orderkey""")
def recovered_quotes(spark: SparkSession, d: str) -> DataFrame:
    """The shortest piece around the line with the day that speaks of an end; schedules of four lines made from the order's key."""
    text = F.concat_ws("\n", pick(_ROW_LINES, "o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd"), pick(_ROW_LINES, "o_orderkey", 5), F.lit("end."))
    rows = load(spark, d, "orders").select("o_orderkey", text.alias("text"), F.col("o_orderdate").cast("date").alias("day"))
    return rows.select("o_orderkey", K.recovered_date_quote(F.col("text"), F.col("day"), "end").alias("quote"))


@query("""
select o_orderkey, case when o_orderkey % 3 <> 2 then o_orderdate::date end as earliest, case when o_orderkey % 3 <> 1 then (o_orderdate::date + 30)::date end as latest, o_orderkey % 3 = 0 and o_orderkey % 2 = 0 as varies from orders""")
def stated_birth_limits(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with `born not earlier than` and `not later than`, dates in two styles; others than births are not limits."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    low = F.concat(F.lit("must have been born not earlier than "), F.date_format(day, "dd.MM.yyyy"))
    high = F.concat(F.when(k % 3 == 2, "be born ").otherwise(" and "), F.lit("not later than "), F.date_format(F.date_add(day, 30), "d MMMM yyyy"))
    other = F.when((k % 3 == 0) & (k % 2 == 0), F.concat(F.lit(". Others: born on or after "), F.date_format(F.date_add(day, 400), "dd/MM/yyyy"))).otherwise("")
    text = F.concat(F.lit("Applications not later than 11.02.2025. A candidate "), F.when(k % 3 != 2, low).otherwise(""), F.when(k % 3 != 1, high).otherwise(""), other)
    return load(spark, d, "orders").select("o_orderkey", F.inline(F.array(D.birth_limits(text))))


_RULES = [("dob", "at least", "01/02/1999"), ("Age", ">=", "21"), ("CGPA", " Minimum ", " 7.5 "), ("Height", "=", "170"), ("Date of Birth", "<=", "soon"), ("qualification", "about", "B.Tech"), ("State", "==", "Kerala")]


@query(f"""
with s as (select o_orderkey, o_orderkey % 7 as k from orders)
select o_orderkey, case k when 0 then 'Date of Birth' when 2 then 'CGPA' when 4 then 'Date of Birth' when 5 then 'Educational Qualification' when 6 then 'State' end as attribute,
  case when k in (0, 1, 2) then '>=' when k in (3, 6) then '=' when k = 4 then '<=' end as operator, case k when 0 then '1999-02-01' when 1 then '21' when 2 then '7.5' when 3 then '170' when 5 then 'B.Tech' when 6 then 'Kerala' end as value,
  case k when 1 then 'Age must be represented as Date of Birth' when 3 then 'Unsupported eligibility attribute: Height' when 4 then 'Unable to normalize date: soon' when 5 then 'Unsupported eligibility operator: about' end as refused from s""")
def normal_rules(spark: SparkSession, d: str) -> DataFrame:
    part = lambda i: pick([r[i] for r in _RULES], "o_orderkey")
    rules = load(spark, d, "orders").select("o_orderkey", part(0).alias("attribute"), part(1).alias("operator"), part(2).alias("value"))
    return K.normal_rule(rules)


_QUALIFIED = ["A degree of a recognised university", "Master's degree in Arts", "10+2 or its equal", "a Diploma or a B. Tech", "class X pass", "Ph. D. or doctoral work", "graduates and post graduates", "matriculate"]


@query(f"""
with s as (select c_custkey, lower({pick_sql(_QUALIFIED, "c_custkey")}) as q, (['10th', '12th / Senior Secondary', 'Diploma', 'Bachelor''s', 'Master''s', 'PhD'])[(c_custkey % 6) + 1] as level from customer)
select c_custkey, case level when '10th' then regexp_matches(q, '\\b(10th|tenth|matric|class\\s*(x|10)\\b|high\\s+school)') when '12th / Senior Secondary' then regexp_matches(q, '\\b(12th|twelfth|10\\s*\\+\\s*2|senior\\s+secondary|higher\\s+secondary|intermediate|hsc)\\b')
  when 'Diploma' then regexp_matches(q, '\\bdiploma\\b') when 'Master''s' then regexp_matches(q, '\\b(master|post\\s*-?\\s*graduat|mtech|msc|mca|mba)') when 'PhD' then regexp_matches(q, '\\b(ph\\.?\\s?d|doctor)')
  else regexp_matches(q, '\\b(bachelor|graduat|undergraduate|degree|btech|bsc|bca|b\\.\\s?(tech|e|sc|a|com|arch)\\b)') and (regexp_matches(q, '\\b(bachelor|undergraduate|b\\.\\s?(tech|e|sc|a|com|arch)\\b)') or not regexp_matches(q, '\\b(master|post\\s*-?\\s*graduat|doctor|ph\\.?\\s?d)')) end as backed from s""")
def levels_backed(spark: SparkSession, d: str) -> DataFrame:
    level = F.element_at(F.array(*map(F.lit, K.LEVEL_NAMES)), (F.col("c_custkey") % 6 + 1).cast("int"))
    return load(spark, d, "customer").select("c_custkey", K.level_backed(level, pick(_QUALIFIED, "c_custkey")).alias("backed"))


@query(r"""
with l as (select doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: trim(x, ' ')), lambda x: x <> '')[1:40]) as line, generate_subscripts(list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: trim(x, ' ')), lambda x: x <> '')[1:40], 1) - 1 as i from documents),
v as (select doc_id, line, i, case when contains(lower(line), 'examination') then 4 when contains(lower(line), 'exam') then 3 else 0 end + case when regexp_matches(line, '[0-9]') then 1 else 0 end + case when upper(line) = line and lower(line) <> line then 2 else 0 end
  + case when i < 10 then 2 else 0 end - case when regexp_matches(lower(line), 'commission|department|university|government') then 2 else 0 end as score from l where length(line) between 5 and 150)
select d.doc_id, (select v.line from v where v.doc_id = d.doc_id order by score desc, i limit 1) as name from documents d""")
def name_lines(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", P.name_line(F.col("text")).alias("name"))


_HEADS = ["SECTION 2: Eligibility and Age", "Part A", "1.2 Age limits of candidates", "1.2.3.4 Too deep a number", "IMPORTANT DATES AND FEES OF ALL", "FEES", "3. one", "Plain words of no form", "Section XE0.7", "2) How to apply for it.", "CONTENTS", "GENERAL RULES ....... 12", "12 34 56 78 90"]


@query(f"""
with h(i, title, level, confidence) as (values (0, 'SECTION 2: Eligibility and Age', 1, 0.6::double), (2, '1.2 Age limits of candidates', 2, 0.65), (9, '2) How to apply for it', 1, 0.65))
select o_orderkey, title, level, confidence from orders left join h on o_orderkey % {len(_HEADS)} = i""")
def detected_headings(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every form: an explicit and two numbered ones are headings; capitals alone never reach their confidence."""
    rows = load(spark, d, "orders").select("o_orderkey", P.detected_heading(pick(_HEADS, "o_orderkey")).alias("h"))
    return rows.select("o_orderkey", "h.title", "h.level", "h.confidence")


@query("""
with r as (select event_id % 2 as q, event_id as ord, ' https://h.example/' || user_id || ' ' as url, event_type as title, case when event_id % 3 = 0 then 'x' else value::varchar end as score from events where event_id % 5 <> 0),
f as (select trim(url) as url, title, try_cast(score as double) as score, row_number() over (partition by trim(url) order by q, ord) as n from r)
select url, title, '' as content, score from f where n = 1""")
def search_results(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    rows = load(spark, d, "events").select((k % 2).alias("q"), k.alias("ord"), F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit(" https://h.example/"), "user_id", F.lit(" "))).alias("url"), F.col("event_type").alias("title"), F.lit(None).cast("string").alias("content"), F.when(k % 3 == 0, "x").otherwise(F.col("value").cast("string")).alias("score"))
    return P.search_results(rows, "q", "url", "title", "content", "score", "ord")


_FEEDBACK = ["The closing DATE is wrong", "please check the age and degree rules", "conducting body missing", "", "looks fine", "marks should be 60 percent, last day too"]


@query(f"""
with s as (select o_orderkey, lower({pick_sql(_FEEDBACK, "o_orderkey")}) as f from orders)
select o_orderkey, array_to_string(list_filter([case when regexp_matches(f, 'name|body|organi|conduct|authority|release') then 'identity' end, case when regexp_matches(f, 'date|deadline|last|start|end|open|close|schedule') then 'dates' end,
  case when regexp_matches(f, 'eligib|age|qualif|nationality|degree|experience|marks|percentage|cgpa|rule') then 'eligibility' end], lambda x: x is not null), ',') as facets,
  array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(f, '[a-z0-9]+'), lambda t: length(t) > 2 and t not in ('the','and','for','with','that','this','from','are','was','were','not','but','has','have','been','should','please','incorrect','wrong','check','again','document')))), ',') as terms,
  greatest(800, 7000 - (o_orderkey % 7000) - 600 - 250) as budget from s""")
def feedback(spark: SparkSession, d: str) -> DataFrame:
    """A reviewer's feedback as facets to search again, extra terms, and the tokens left for passages."""
    said = pick(_FEEDBACK, "o_orderkey")
    terms = F.array_sort(F.transform(V.feedback_terms(said), lambda t: t["term"]))
    budget = V.context_budget(F.lit(7000).cast("long"), F.col("o_orderkey") % 7000, F.lit(600).cast("long"))
    return load(spark, d, "orders").select("o_orderkey", F.array_join(V.feedback_facets(said), ",").alias("facets"), F.array_join(terms, ",").alias("terms"), budget.alias("budget"))


@query("""
with s as (select o_custkey, o_orderkey, o_orderkey % 2 = 0 as overview, o_orderpriority like '1%' as rejected, (o_totalprice % 70) / 10 as raw, case when o_orderkey % 6 <> 0 then (o_orderkey % 40)::int end as page from orders),
f as (select *, case when overview then greatest(raw, 2.5) else raw end as score from s), k as (select *, row_number() over (partition by o_custkey order by page nulls last, o_orderkey) as place from f where not rejected and score >= 2.5)
select o_custkey, o_orderkey, place::int as place from k where place <= 3""")
def selected_sections(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sections of a customer's document: overviews score 2.5 at least, urgent ones are rejected, the first three stay."""
    key = F.col("o_orderkey")
    rows = load(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(key % 2 == 0, "Overview").otherwise("Fees").alias("title"), F.col("o_orderpriority").startswith("1").alias("rejected"), ((F.col("o_totalprice") % 70) / 10).alias("raw"), F.when(key % 6 != 0, (key % 40).cast("int")).alias("page"))
    scored = rows.withColumn("r", P.section_relevance(F.col("title"), F.col("raw"), F.col("rejected"), "(?i)^overview")).select("*", "r.*")
    return P.selected_sections(scored, "o_custkey", "o_orderkey", "page", "score", most=3).select("o_custkey", "o_orderkey", "place")


@query(r"""
with v as (select page_id, url, unnest(regexp_extract_all(html, '(?i)\s(?:href|src|data-href|data-url|data-file|data-download|data-document|onclick|value)\s*=\s*("[^"]*"|''[^'']*'')', 1)) as q from pages),
h as (select page_id, url, trim(q[2:length(q) - 1]) as v from v),
a as (select page_id, case when regexp_matches(v, '^https?://') then v else regexp_extract(url, '^(https?://[^/?#]+)', 1) || v end as link, url, v from h where regexp_matches(v, '^(https?://|/)[^\s()''"]*$')),
s as (select page_id, link, string_split(lower(regexp_extract(link, '^https?://([^/?#:]+)', 1)), '.') as lh, string_split(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '.') as uh from a where link like 'https://%')
select distinct page_id, link from s where lh = uh or (len(lh) >= 3 and len(uh) >= 3 and lh[-3:] = uh[-3:])""")
def mined_addresses(spark: SparkSession, d: str) -> DataFrame:
    return P.mined_addresses(load(spark, d, "pages"), "page_id", "url", "html").select("page_id", "link")


@query("""
with s as (select o_orderkey, (o_orderkey % 40)::int as lo, case when o_orderkey % 3 <> 0 then (o_orderkey % 31)::int end as hi, o_orderkey % 4 = 0 as na, (o_orderkey % 2)::int as rules from orders)
select o_orderkey, array_to_string(list_filter([case when lo > hi then 'minimum-age-above-maximum' end, case when na and rules > 0 then 'rules-though-not-available' end, case when not na and rules = 0 then 'no-rules' end], lambda x: x is not null), ',') as issues,
  o_orderkey % 5 <> 0 and (o_orderkey % 3 = 0 or o_orderkey % 7 <> 0 or rules > 0) as usable from s""")
def manual_entries(spark: SparkSession, d: str) -> DataFrame:
    """Eligibility entered by hand, and whether an extraction is worth a review."""
    k = F.col("o_orderkey")
    rules = (k % 2).cast("int")
    issues = X.manual_issues((k % 40).cast("int"), F.when(k % 3 != 0, (k % 31).cast("int")), k % 4 == 0, rules)
    usable = X.is_usable(F.when(k % 5 != 0, "name"), F.when(k % 3 == 0, 1).otherwise(0), F.when(k % 7 != 0, F.col("o_orderdate")), rules)
    return load(spark, d, "orders").select("o_orderkey", F.array_join(issues, ",").alias("issues"), usable.alias("usable"))


@query("""
select o_orderkey, case when o_orderkey % 5 = 0 then 'Exam' else 'Test ' || o_custkey end || case when o_orderkey % 2 = 0 then ' conducted by ' || o_orderpriority else '' end || '.'
  || case when o_orderkey % 3 = 0 then '' when o_orderkey % 3 = 1 then ' Applications: ' || o_orderdate::date || ' to unknown.' else ' Applications: start date not announced to ' || o_orderdate::date || '.' end
  || ' Exam: ' || o_orderdate::date || ', ' || o_orderdate::date || ' to ' || (o_orderdate::date + 2)::date || '. ' || (o_orderkey % 9) || ' eligibility rule(s) extracted.' || case when o_orderkey % 4 = 0 then ' ' || (o_orderkey % 7 + 1) || ' issue(s) need review before approval.' else '' end as summary from orders""")
def summaries(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    later = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 2), "yyyy-MM-dd")
    dates = F.array(F.struct(day.alias("start"), day.alias("end")), F.struct(day.alias("start"), later.alias("end")))
    text = X.summary(F.when(k % 5 != 0, F.concat(F.lit("Test "), "o_custkey")), F.when(k % 2 == 0, F.col("o_orderpriority")), F.when(k % 3 == 1, day), F.when(k % 3 == 2, day), dates, k % 9, F.when(k % 4 == 0, k % 7 + 1).otherwise(0))
    return load(spark, d, "orders").select("o_orderkey", text.alias("summary"))


@query("select user_id || ' ' || event_type as flight, min(event_id) as event_id from events where ts = (select min(ts) from events e where e.user_id = events.user_id and e.event_type = events.event_type) group by all")
def single_flights(spark: SparkSession, d: str) -> DataFrame:
    """Requests of a user for a thing, in odd spacing and case: the first of each."""
    events = load(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    key = F.concat(F.lit("  "), F.col("user_id"), F.lit("   "), F.upper("event_type"), F.lit(" "))
    return S.single_flight(events, key, "at", "60 days").select("flight", "event_id")


@query("""
with r as (select distinct o_custkey, o_orderdate::date as a, (o_orderdate::date + (o_orderkey % 3)::int)::date as b from orders where o_orderkey % 4 <> 0),
t as (select o_custkey, string_agg(a || '/' || b, ',' order by a, b) as ranges, min(a) < date '1995-06-01' as before_deadline from r group by o_custkey)
select distinct o.o_custkey, coalesce(t.ranges, '') as ranges, coalesce(t.before_deadline, false) as before_deadline from orders o left join t on o.o_custkey = t.o_custkey""")
def exam_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as exam dates, every fourth one without a quote that backs it."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    found = K.exam_ranges(load(spark, d, "orders"), "o_custkey", day, F.date_add(day, (k % 3).cast("int")), k % 4 != 0, F.lit("1995-06-01").cast("date"))
    text = F.array_join(F.transform("ranges", lambda r: F.concat_ws("/", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return found.select("o_custkey", text.alias("ranges"), "before_deadline")


@query("""
select o_orderkey, c_mktsegment as segment, case when o_orderkey % 5 <> 0 then o_orderkey % 4 end as n_changes, case when o_orderkey % 5 <> 0 then o_orderpriority end as summary
from orders join customer on o_custkey = c_custkey where o_orderstatus = 'O'""")
def listed_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Open orders as reviews with a report, every fifth one broken, beside their customers."""
    k = F.col("o_orderkey")
    items = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(i <= k % 4, i.cast("string"))), ",")
    report = F.concat(F.when(k % 5 == 0, "{").otherwise(""), F.lit('{"changes":['), items, F.lit('],"summary":"'), "o_orderpriority", F.lit('"}'))
    rows = load(spark, d, "orders").select(k, F.col("o_custkey").alias("c_custkey"), "o_orderstatus", report.alias("report"))
    found = C.listed_reviews(rows, load(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), "c_custkey", "report", "o_orderstatus", "O")
    return found.select("o_orderkey", "segment", F.col("n_changes").cast("long").alias("n_changes"), "summary")


@query("""
with s as (select event_id, event_id % 8 as attempts, epoch_us(timestamp '2024-01-20 00:00:00') - epoch_us(ts) as age from events where ts <= timestamp '2024-01-20 00:00:00')
select event_id, case when age > 86400000000 then 'purged' when age > 600000000 then 'expired' when attempts >= 5 then 'locked' else 'open' end as state from s""")
def signup_codes(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    events = load(spark, d, "events").withColumn("sent", F.col("ts").cast("timestamp")).where(F.col("sent") <= now)
    return events.select("event_id", M.code_state(F.col("sent"), F.col("event_id") % 8, now).alias("state"))


@query("""
with c as (select *, event_id % 3 as tier, row_number() over (partition by user_id order by event_id % 3, value desc, event_id desc) as r from events where event_type <> 'error')
select user_id, event_id, tier from c where r = 1""")
def first_passing(spark: SparkSession, d: str) -> DataFrame:
    """Events as candidates in three tiers: the best of the first tier in which one is no error."""
    rows = load(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 3).alias("tier"), "value", "event_type")
    return P.first_passing(rows, "user_id", "tier", "value", "event_id", F.col("event_type") != "error").select("user_id", "event_id", "tier")


@query("""
select o_orderkey, case when o_orderkey % 3 = 0 then strftime(o_orderdate, '%Y-%m-%d') end as opens, case when o_orderkey % 4 <> 1 then strftime(o_orderdate, '%Y-%m-%d') end as closes,
  array_to_string(list_filter([case when o_orderkey % 3 = 1 then 'opens' end, case when o_orderkey % 4 = 1 then 'closes' end], lambda x: x is not null), ',') as refused from orders""")
def normal_information(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    opens = F.when(k % 3 == 0, F.date_format("o_orderdate", "d MMMM yyyy")).when(k % 3 == 1, "to be announced").otherwise(" ")
    closes = F.when(k % 4 == 1, "in May").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    found = K.normal_information(load(spark, d, "orders").select(k, opens.alias("opens"), closes.alias("closes")), ["opens", "closes"])
    return found.withColumn("refused", F.array_join("refused", ","))
