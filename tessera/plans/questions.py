"""Question queries: the users' turns of conversations ask about parts, whose lines are notices with dates and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profiles as A
from ..operators import questions as Q
from ..sources.tables import load
from .registry import query
from .rules import applicants
from .trees import _NUMBERED, numbered_lines

_STOP = "[" + ", ".join(f"'{w}'" for w in A.QUESTION_WORDS) + "]"


def _words(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda t: length(t) > 1 and not list_contains({_STOP}, t) and not regexp_full_match(t, '(19|20)[0-9][0-9]')))"


_ASKED = """
q as (
select conv_id * 1000 + turn as question_id, (conv_id * 3 + turn) % 120 + 1 as student_id, 'Please tell me about the ' || p_name || ' and ' || text as message
from conversations join part on p_partkey = (conv_id * 7 + turn * 3) % 200 where role = 'user')"""
_MATCHED = f"""
{_ASKED},
asked as (select question_id, {_words("message")} as asked from q),
items as (select p_partkey, p_name, {_words("p_name")} as own, {_words("p_brand")} as told from part),
scores as (
select question_id, p_partkey, p_name, len(list_intersect(asked, own)) as o, len(list_intersect(asked, told)) > 0 as t from asked, items),
m as (
select question_id, p_partkey, p_name, (case when o > 0 then o else 1 end)::bigint as overlap,
       row_number() over (partition by question_id order by case when o > 0 then o else 1 end desc, p_name, p_partkey)::int as place
from scores where o > 0 or t qualify place <= 3)"""


def asked(spark: SparkSession, d: str) -> DataFrame:
    turns, part = load(spark, d, "conversations").where("role = 'user'"), load(spark, d, "part")
    rows = turns.join(part, F.col("p_partkey") == (F.col("conv_id") * 7 + F.col("turn") * 3) % 200)
    message = F.concat(F.lit("Please tell me about the "), "p_name", F.lit(" and "), "text")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), ((F.col("conv_id") * 3 + F.col("turn")) % 120 + 1).alias("student_id"), message.alias("message"))


@query(f"with {_MATCHED} select * from m")
def question_matches(spark: SparkSession, d: str) -> DataFrame:
    return Q.matched(asked(spark, d), "question_id", "message", load(spark, d, "part"), "p_partkey", "p_name", "p_brand")


@query("""
with s as (
select distinct trim(case p_partkey % 4 when 0 then p_type || ' ' || p_brand when 1 then substr(p_name, 2) when 2 then split_part(p_name, ' ', 2) || ' #' || p_size else substr(p_type, 1, 2) end) as search
from part),
i as (select p_partkey, lower(p_name || ' ' || p_brand || ' ' || p_type) as text from part)
select search, p_partkey from s, i
where contains(text, lower(search)) or len(list_filter(regexp_extract_all(lower(search), '[a-z0-9]+'), lambda w: not contains(text, w))) = 0""")
def catalogue_searches(spark: SparkSession, d: str) -> DataFrame:
    """Whole words, parts of words and marks out of the parts themselves, each a search over all parts."""
    part = load(spark, d, "part")
    k = F.col("p_partkey")
    second = F.concat(F.element_at(F.split("p_name", " "), 2), F.lit(" #"), F.col("p_size").cast("string"))
    message = F.when(k % 4 == 0, F.concat_ws(" ", "p_type", "p_brand")).when(k % 4 == 1, F.expr("substring(p_name, 2)")).when(k % 4 == 2, second).otherwise(F.left("p_type", F.lit(2)))
    searches = part.select(F.trim(message).alias("search")).distinct().withColumn("message", F.col("search"))
    items = part.select("p_partkey", "p_name", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    return Q.searched(searches, "search", "message", items, "p_partkey", "p_name", "text")


_NOTICES = f"""
l as (
select l_orderkey * 100 + n as id, l_partkey as exam_id, case when l_linenumber <> 1 then l_shipdate::date end as released, case when l_tax <> 0 then l_shipdate::date - 30 end as opens,
       l_linestatus as summary, l_returnflag = 'A' as approved, l_linestatus = 'O' as ruled, (l_quantity * 100)::int as least, l_linenumber % 2 = 0 as dated, l_shipdate::date as day
from ({_NUMBERED})),
shown as (select * from l where approved qualify row_number() over (partition by exam_id order by released is not null desc, released desc, id) = 1),
ruling as (select * from l where approved qualify row_number() over (partition by exam_id order by coalesce(released, date '0001-01-01') desc, id desc) = 1),
facts as (
select p_partkey as exam_id, 'Notice ' || s.id as title, r.ruled, r.least,
       concat_ws(chr(10), 'EXAM: ' || p_name, 'Type: ' || p_type, 'Description: ' || p_brand,
         case when s.id is null then 'No approved official notification is on file for this exam yet, so specific dates/eligibility rules are not available.' end,
         'Latest official notification: Notice ' || s.id, 'Notification release date: ' || s.released, 'Application start date: ' || s.opens,
         case when s.dated then 'Exam date window: ' || (s.day + 60) || ' to ' || (s.day + 61) end, 'Notification summary: ' || s.summary,
         case when r.ruled then 'Eligibility rules:' || chr(10) || '- (AND) CGPA >= ' || r.least || chr(10) || '  - (OR) State = BUILDING OR State = MACHINERY' end) as facts
from part left join shown s on s.exam_id = p_partkey left join ruling r on r.exam_id = p_partkey)"""


@query(f"""
with {_MATCHED}, {_NOTICES},
c as (select c_custkey as student_id, case when c_custkey % 5 <> 0 then c_acctbal end as cgpa, c_mktsegment as seg from customer),
block as (
select m.question_id, place, concat_ws(chr(10), f.facts, case when f.ruled and c.student_id is not null then
         'This student''s computed eligibility: ' || case when coalesce(cgpa >= least, false) and seg in ('BUILDING', 'MACHINERY') then 'ELIGIBLE. Reasons: All applicable eligibility requirements were satisfied.'
         else 'NOT ELIGIBLE. Reasons: ' || array_to_string(list_filter([
           case when not coalesce(cgpa >= least, false) then 'Requirement not satisfied: CGPA >= ' || least || case when cgpa is null then ' (add this to your profile)' else '' end end,
           case when seg not in ('BUILDING', 'MACHINERY') then 'Requirement not satisfied: State = BUILDING' end,
           case when seg not in ('BUILDING', 'MACHINERY') then 'Requirement not satisfied: State = MACHINERY' end], lambda x: x is not null), '; ') end end) as block,
       p_name || coalesce('|' || title, '') as source
from m join q on q.question_id = m.question_id join facts f on f.exam_id = m.p_partkey left join c on c.student_id = q.student_id),
b as (select question_id, string_agg(block, chr(10) || chr(10) order by place) as details, string_agg(source, ',' order by place) as sources from block group by question_id)
select q.question_id, coalesce('STUDENT PROFILE STATUS: date of birth ' || case when c.student_id % 4 <> 0 then 'saved' else 'not saved' end || '; nationality saved; state saved; academic details '
         || case when cgpa is not null then 'added' else 'not added' end || '.', '') as profile,
       coalesce(details, '') as details, coalesce(sources, '') as sources, b.question_id is not null as grounded
from q left join b on b.question_id = q.question_id left join c on c.student_id = q.student_id""")
def answer_contexts(spark: SparkSession, d: str) -> DataFrame:
    part, lines = load(spark, d, "part"), numbered_lines(spark, d)
    exams = part.select(F.col("p_partkey").alias("exam_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("description"), F.lit(None).cast("string").alias("url"))
    ident, day = (F.col("l_orderkey") * 100 + F.col("n")).alias("id"), F.col("l_shipdate").cast("date")
    lines = lines.withColumns({"id": ident, "day": day})
    notices = lines.select(
        F.col("id").alias("notification_id"), F.col("l_partkey").alias("exam_id"), F.concat(F.lit("Notice "), F.col("id")).alias("title"), F.when(F.col("l_linenumber") != 1, F.col("day")).alias("release_date"),
        F.when(F.col("l_tax") != 0, F.date_sub("day", 30)).alias("application_start_date"), F.lit(None).cast("date").alias("application_end_date"), F.col("l_linestatus").alias("summary"),
        F.when(F.col("l_returnflag") == "A", "APPROVED").otherwise("PENDING").alias("approval_status"),
    )
    dates = lines.where("l_linenumber % 2 = 0").select(F.col("id").alias("exam_date_id"), F.col("id").alias("notification_id"), F.date_add("day", 60).alias("start_date"), F.date_add("day", 61).alias("end_date"))
    ruled = lines.where("l_linestatus = 'O' and l_returnflag = 'A'")
    low = F.col("id") + F.lit(1000000000000)
    none = F.lit(None).cast("long")
    group = lambda number, parent, op: ruled.select(F.col("id").alias("notice"), number.alias("group_id"), parent.alias("parent_group_id"), F.lit(1).alias("group_number"), F.lit(op).alias("logical_operator"))
    groups = group(F.col("id"), none, "AND").unionByName(group(low, F.col("id"), "OR"))
    rule = lambda i, number, name, op, value, kind: ruled.select((F.col("id") * 10 + i).alias("rule_id"), number.alias("group_id"), F.lit(name).alias("attribute"), F.lit(op).alias("operator"), value.alias("value"), F.lit(kind).alias("data_type"))
    rules = rule(0, F.col("id"), "CGPA", ">=", (F.col("l_quantity") * 100).cast("int").cast("string"), "numeric")
    rules = rules.unionByName(rule(1, low, "State", "=", F.lit("BUILDING"), "text")).unionByName(rule(2, low, "State", "=", F.lit("MACHINERY"), "text"))
    people = applicants(spark, d)
    flags = people.select("student_id", (F.col("student_id") % 4 != 0).alias("has_date_of_birth"), F.lit(True).alias("has_nationality"), F.lit(True).alias("has_state"), (F.col("student_id") % 5 != 0).alias("has_academics"))
    found = Q.answer_contexts(asked(spark, d), exams, notices, dates, groups, rules, people, flags)
    sources = F.array_join(F.transform("sources", lambda s: F.concat_ws("|", s["name"], s["title"])), ",")
    return found.select("question_id", "profile", "details", sources.alias("sources"), "grounded")
