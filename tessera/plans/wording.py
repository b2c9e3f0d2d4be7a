"""Queries on rule wording, headings and links: phrases made from the tables' columns, judged by independent SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import compiling as K
from ..operators import documents as P
from ..operators import rules as R
from ..sources.tables import load
from .registry import query


def pick(phrases: list[str], key: str, step: int = 1) -> Column:
    """One of the phrases by key."""
    return F.element_at(F.array(*map(F.lit, phrases)), (F.pmod(F.floor(F.col(key) / step), F.lit(len(phrases))) + 1).cast("int"))


def pick_sql(phrases: list[str], key: str, step: int = 1) -> str:
    listed = ", ".join("'" + p.replace("'", "''") + "'" for p in phrases)
    return f"([{listed}])[(({key} // {step}) % {len(phrases)}) + 1]"


_OPS = [" At Least ", "equal", "NOT EQUAL TO", "===", "more than", "<>", "below", "Maximum", ">=", "is", "not equal", "greater than or equal to", "under", "  minimum", "at  most", "=", "above", "=>", "less than or equal to", "!="]


@query(f"""
with s as (select o_orderkey, lower(trim({pick_sql(_OPS, "o_orderkey")})) as b from orders)
select o_orderkey, case when regexp_full_match(b, '=+') or b in ('equal', 'equals', 'equal to') then '=' when b in ('!=', 'not equal', 'not equal to') then '!='
  when b in ('>', 'greater than', 'above') then '>' when b in ('>=', 'greater than or equal to', 'at least', 'minimum') then '>='
  when b in ('<', 'less than', 'below') then '<' when b in ('<=', 'less than or equal to', 'at most', 'maximum') then '<=' end as symbol from s""")
def operator_symbols(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", T.operator_symbol(pick(_OPS, "o_orderkey")).alias("symbol"))


_ATTRIBUTES = ["CGPA", " dob ", "Qualification", "age", "Work Experience", "nationality", "height", "Date of Birth", "STATE"]


@query(f"""
with s as (select o_orderkey, lower(trim({pick_sql(_ATTRIBUTES, "o_orderkey")})) as b from orders)
select o_orderkey, case when b = 'cgpa' then 'CGPA' when b in ('dob', 'date of birth') then 'Date of Birth' when b in ('qualification', 'educational qualification') then 'Educational Qualification'
  when b in ('percentage', 'specialization', 'nationality', 'state') then upper(b[1]) || b[2:] when b = 'work experience' then 'Work Experience' end as label from s""")
def attribute_labels(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", T.attribute_label(pick(_ATTRIBUTES, "o_orderkey")).alias("label"))


_APPLIES = ["", "General", "OBC candidates", "all candidates", "Defence personnel", "the handicapped", "persons", "government servants", "open to everyone"]
_QUOTES = ["The maximum age is 30 years", "relaxable by five years for SC and ST", "up to a maximum of three years in the case of servicemen", "age as on the date", "five years for widows", "relaxation in the upper limit"]
# What each phrase says: whom it applies to in general (yes), to a category (no), neither; a concession or not.
_APPLIES_TO = ["", "yes", "no", "yes", "no", "no", "", "no", "yes"]
_CONCESSION = ["no", "yes", "yes", "no", "yes", "yes"]


@query(f"""
with s as (select c_custkey, {pick_sql(_APPLIES_TO, "c_custkey")} as a, {pick_sql(_CONCESSION, "c_custkey", 9)} as q from customer)
select c_custkey, case when a <> '' then a = 'yes' else q = 'no' end as general from s""")
def general_limits(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select("c_custkey", K.is_general_limit(pick(_APPLIES, "c_custkey"), pick(_QUOTES, "c_custkey", 9)).alias("general"))


#: Detected headings, and whether they are fragments always, never while numbered, or as their level and confidence say.
_HEADINGS = [("Eligibility of candidates", ""), ("XE1.2 Fluids", "always"), ("IMPORTANT, DATES", "always"), ("TDS, of water", "always"), ("3. This certificate is", "always"), ("Part A consists of", "always"), ("2.1 Age limits", "numbered"), ("Fees for all", "")]
_NUMBERS = "one two three four five six seven eight nine ten eleven twelve".split()


@query(f"""
select p_partkey, list_sort(list_distinct(['10', p_size::varchar, (p_partkey % 12 + 1)::varchar, (p_partkey * 7)::varchar])) as digits from part""")
def number_words(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("TEN of "), F.col("p_size"), F.lit(" and "), pick(_NUMBERS, "p_partkey"), F.lit("; often 0"), F.col("p_partkey") * 7, F.lit(" tens"))
    return load(spark, d, "part").select("p_partkey", F.array_sort(T.digits(text)).alias("digits"))


_FORMS = ["%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y", "%d-%m-%Y", "%d/%m/%y", "%d.%m.%y", "%d-%m-%y", "%d %B, %Y", "%d %B %Y", "%d %b, %Y", "%d %b %Y", "%B %d, %Y", "%B %d %Y", "%b %d, %Y", "%b %d %Y", "%Y/%m/%d"]
_SPARK_FORMS = ["yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy", "dd-MM-yyyy", "dd/MM/yy", "dd.MM.yy", "dd-MM-yy", "dd MMMM, yyyy", "dd MMMM yyyy", "dd MMM, yyyy", "dd MMM yyyy", "MMMM dd, yyyy", "MMMM dd yyyy", "MMM dd, yyyy", "MMM dd yyyy", "yyyy/MM/dd"]


@query(f"""
with s as (select o_orderkey, o_orderkey % 16 as k, case o_orderkey % 16 {" ".join(f"when {i} then strftime(o_orderdate, '{f}')" for i, f in enumerate(_FORMS))} end as t from orders)
select o_orderkey, case k {" ".join(f"when {i} then try_strptime(t, '{f}')::date" for i, f in enumerate(_FORMS[:15]))} end as day from s""")
def all_date_forms(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen written forms that are read, and one that is not."""
    text = F.lit(None).cast("string")
    for i, form in enumerate(_SPARK_FORMS):
        text = F.when(F.col("o_orderkey") % 16 == i, F.date_format("o_orderdate", form)).otherwise(text)
    return load(spark, d, "orders").select("o_orderkey", D.normal_date(text).alias("day"))


_LABELS = ["Information Brochure 2027", "Recruitment Notice", "Photo Gallery", "Annual-Report 2026", "FAQ on admission", "ADVT no 12", "Sample paper", "Alumni profile", "Examination notification 2026"]


@query(f"""
with s as (select page_id, url, {pick_sql(_LABELS, "page_id")} as label from pages),
v as (select page_id, lower(url || ' ' || label) as t, list_filter(regexp_extract_all(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '[0-9]+'), lambda x: regexp_full_match(x, '20[0-9][0-9]')) as uy,
  list_filter(regexp_extract_all(label, '[0-9]+'), lambda x: regexp_full_match(x, '20[0-9][0-9]')) as ly from s)
select page_id, (case when regexp_matches(t, 'history|gallery|annual[ _-]report|newsletter|magazine|tender|convocation|sports|cultural|syllabus|answer[ _]?key|question[ -]?paper|test[ -]?paper|sample[ -]?paper|previous year|old paper')
    or not (contains(t, 'page') or contains(t, 'example')) or (len(uy) > 0 and not list_contains(uy, '2027')) then -100
  else (case when contains(t, '.pdf') then 5 else 0 end)
    + len(list_filter(['notification','advertisement','notice','examination','exam','recruitment','application','brochure','information','circular','download'], lambda w: contains(t, w)))
    + 6 * len(list_filter(['information brochure','info brochure','notification','advertisement','advt','brochure'], lambda w: contains(t, w)))
    - 15 * len(list_filter(['about us','about-us','rti','right to information','press release','press-release','profile','vision and mission','org chart','organogram','citizen charter','grievance','faq','media coverage','achievements','success stor','alumni'], lambda w: contains(t, w)))
    + 4 * ((case when contains(t, 'page') then 1 else 0 end) + (case when contains(t, 'example') then 1 else 0 end))
    + (case when len(uy) > 0 then 5 when len(ly) = 0 then 0 when list_contains(ly, '2027') then 5 else -8 end) end)::bigint as score from v""")
def document_links(spark: SparkSession, d: str) -> DataFrame:
    """Every page's address under a label, as a link that may be the wanted document of 2027."""
    score = P.document_link_score(F.col("url"), pick(_LABELS, "page_id"), ["page", "example"], ["2027"])
    return load(spark, d, "pages").select("page_id", score.alias("score"))


_LINES = ["1. Age Limits and Relaxation", "SECTION 2", "Eligibility conditions for all the candidates of this year apply.", "B1.2", "IMPORTANT DATES", "2) How To Apply", "", "12 34 56 78 90", "Fees", "PART B", "General Instructions To Be Read By Every Candidate Before"]


@query(f"""
with s as (select o_orderkey, {pick_sql(_LINES, "o_orderkey")} as l from orders),
v as (select *, upper(trim(l)) as u, len(regexp_extract_all(l, '\\S+')) as w, len(regexp_extract_all(l, '[0-9]')) as n from s)
select o_orderkey, u = '' or not regexp_matches(u, '[A-Z]') or regexp_full_match(u, '[A-Z]{{1,4}}[0-9]+(\\.[0-9]+)*[:.]?') or regexp_full_match(u, '(SECTION|CHAPTER|PART)\\s+[A-Z0-9]+(\\.[0-9]+)*') or u = 'FEES' as noise,
  round(greatest(0.0, least(1.0, (case when w >= 2 then 0.20 else 0 end) + (case when length(l) between 8 and 100 then 0.15 else 0 end)
    + (case when regexp_matches(l, '^\\s*[0-9]+[.)]') then 0.30 when regexp_matches(u, '[A-Z]') and upper(l) = l then 0.05 else 0 end)
    + (case when regexp_matches(u, '^(SECTION|PART)') then 0.25 else 0 end)
    - (case when length(l) > 120 or (w >= 8 and regexp_matches(l, '[.?!]$')) then 0.45 else 0 end) - (case when n::double / greatest(1, length(l)) > 0.30 then 0.25 else 0 end))), 2)::double as confidence from v""")
def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    line = pick(_LINES, "o_orderkey")
    explicit = F.upper(line).rlike("^(SECTION|PART)")
    return load(spark, d, "orders").select("o_orderkey", P.is_noise(line, ["FEES"]).alias("noise"), P.heading_confidence(line, explicit).alias("confidence"))


_EDGE = r"[^\p{L}\p{N}_]"


@query(f"""
with s as (select doc_id, ' ' || lower(text[1:600]) || ' ' as t from documents)
select doc_id, (case when regexp_matches(t, '{_EDGE}(en|de|la){_EDGE}') then 1 else 0 end) + (case when regexp_matches(t, '{_EDGE}the{_EDGE}') then 1 else 0 end)
  + (case when regexp_matches(t, '{_EDGE}and{_EDGE}') then 1 else 0 end) >= 2 as matches from s""")
def content_words(spark: SparkSession, d: str) -> DataFrame:
    """Whether the start of a text names two of three words."""
    return load(spark, d, "documents").select("doc_id", P.content_matches(F.col("text"), ["(en|de|la)", "the", "and"], [], span=600).alias("matches"))


@query("""
with s as (select page_id, lower(url) as u, lower(html) as x, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) as h from pages)
select page_id, ((case when contains(u || x, 'official') then 12 else 0 end) + (case when contains(u || x, 'notification') then 10 else 0 end)
  + (case when contains(u, 'information brochure') or contains(x, 'information brochure') then 9 else 0 end) + (case when contains(u, 'examination') or contains(x, 'examination') then 5 else 0 end)
  + (case when contains(u, 'application') or contains(u, 'admission') then 3 else 0 end) + (case when contains(h, '.gov.in') or contains(h, '.nic.in') then 8 else 0 end) + (case when contains(h, '.gov.') then 8 else 0 end)
  + (case when contains(h, '.ac.in') or contains(h, '.edu.in') then 6 else 0 end) + (case when contains(h, '.ac.') or contains(h, '.edu.') then 4 else 0 end))::bigint as score from s""")
def source_scores(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", P.source_score(F.col("url"), F.col("html"), T.host(F.col("url"))).alias("score"))


@query("""
select o_custkey, case when count(distinct o_orderdate::date) = 1 then min(o_orderdate::date) end as day from orders group by o_custkey""")
def single_days(spark: SparkSession, d: str) -> DataFrame:
    """The one day on which a customer ordered; null for none or several."""
    days = load(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderdate").cast("date")).alias("days"))
    return days.select("o_custkey", D.only_one(F.col("days")).alias("day"))


@query("""
with b as (select o_custkey, o_orderdate::date as v, case o_orderkey % 4 when 0 then '>=' when 1 then '<=' when 2 then '>' else '<' end as op from orders),
s as (select o_custkey, max(v) filter (op in ('>', '>=')) as lo, max(v) filter (op = '>') as slo, min(v) filter (op in ('<', '<=')) as hi, min(v) filter (op = '<') as shi from b group by o_custkey)
select o_custkey as group_id, 'date of birth' as attribute from s where lo > hi or (lo = hi and (slo = lo or shi = hi))""")
def date_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's orders as bounds on a date of birth in one AND group: which can't all hold."""
    orders = load(spark, d, "orders")
    op = F.element_at(F.array(*map(F.lit, (">=", "<=", ">", "<"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rules = orders.select(F.col("o_orderkey").alias("rule_id"), F.col("o_custkey").alias("group_id"), F.lit("Date of Birth").alias("attribute"), op.alias("operator"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value"))
    groups = rules.select("group_id", F.lit("AND").alias("logical_operator")).distinct()
    return R.contradictions(groups, rules, "date")


@query("""
with c as (select c_custkey, c_acctbal as bal, case when c_custkey % 7 <> 0 then c_acctbal end as fact, (c_custkey % 6)::int as k from customer)
select c_custkey as student_id, coalesce(case k when 0 then fact = 4000 when 1 then fact <> 4000 when 2 then fact > 4000 when 3 then fact >= 4000 when 4 then fact < 4000 else fact <= 4000 end, false) as ok from c""")
def typed_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """Every comparison on numbers, by customer; a customer without the fact fails whatever the operator."""
    c = load(spark, d, "customer").withColumn("fact", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))
    op = F.element_at(F.array(*map(F.lit, R.OPERATORS)), (F.col("c_custkey") % 6 + 1).cast("int"))
    rules = c.select(F.col("c_custkey").alias("rule_id"), F.col("c_custkey").alias("student_id"), F.lit("CGPA").alias("attribute"), op.alias("operator"), F.lit("4000").alias("value"), F.lit("numeric").alias("data_type"))
    facts = c.select(F.col("c_custkey").alias("student_id"), F.create_map(F.lit("cgpa"), F.col("fact").cast("string")).alias("facts"), F.array().cast("array<string>").alias("work"))
    return R.compare_leaves(R.prepared(rules).join(facts, "student_id")).select("student_id", "ok")


@query("""
with e as (select o_custkey, min(o_orderkey) as k from orders where o_orderstatus = 'O' group by o_custkey),
w as (select o_custkey, list(o_orderpriority order by o_orderkey) as held from orders where o_orderstatus = 'F' and o_orderkey % 3 <> 0 group by o_custkey)
select c_custkey as student_id, c_mktsegment as nationality, c_name as state, strftime(date '1990-01-01' + (c_custkey % 3000)::int, '%Y-%m-%d') as born, o.o_orderpriority as qualification,
  year(o.o_orderdate)::varchar as passed, coalesce(array_to_string(w.held, '|'), '') as work
from customer left join e on c_custkey = e.o_custkey left join orders o on o.o_orderkey = e.k left join w on c_custkey = w.o_custkey""")
def applicant_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts from a student's row, the current education (the first open order) and work experience (finished orders)."""
    students, educations, work = people(spark, d)
    fact = lambda name: F.try_element_at("facts", F.lit(name))
    found = R.applicant_facts(students, educations, work)
    return found.select("student_id", fact("nationality").alias("nationality"), fact("state").alias("state"), fact("date of birth").alias("born"), fact("educational qualification").alias("qualification"), fact("year of passing").alias("passed"), F.array_join("work", "|").alias("work"))


def people(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, orders = load(spark, d, "customer"), load(spark, d, "orders")
    born = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("c_custkey") % 3000).cast("int"))
    students = c.select(F.col("c_custkey").alias("student_id"), F.col("c_mktsegment").alias("nationality"), F.col("c_name").alias("state"), F.lit(None).cast("string").alias("gender"), born.alias("date_of_birth"))
    number = F.lit(None).cast("int")
    educations = orders.select(F.col("o_orderkey").alias("education_id"), F.col("o_custkey").alias("student_id"), F.col("o_orderpriority").alias("qualification"), F.lit(None).cast("string").alias("specialization"), F.col("o_totalprice").alias("cgpa"), F.lit(None).cast("double").alias("percentage"), number.alias("current_year"), F.year("o_orderdate").alias("year_of_passing"), (F.col("o_orderstatus") == "O").alias("is_current"))
    duration = F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise(F.col("o_orderpriority"))
    work = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("work_experience_id"), F.col("o_custkey").alias("student_id"), duration.alias("duration"))
    return students, educations, work


@query("""
with e as (select o_custkey, arg_min(o_totalprice, o_orderkey) as cgpa from orders where o_orderstatus = 'O' group by o_custkey),
t as (select c_custkey, 1 + c_custkey % 3 as exam, c_mktsegment, cgpa from customer left join e on c_custkey = o_custkey where c_custkey % 5 <> 0),
n as (select *, case when exam = 1 then case when coalesce(cgpa >= 100000, false) or c_mktsegment = 'BUILDING' then 'ELIGIBLE' else 'NOT_ELIGIBLE' end else 'UNKNOWN' end as now_,
   case when c_custkey % 4 = 0 then null when c_custkey % 4 = 1 then 'ELIGIBLE' else 'NOT_ELIGIBLE' end as old from t where exam <> 2)
select exam::bigint as exam_id, c_custkey as student_id, old as old_status, now_ as new_status, coalesce(old <> now_, false) as status_changed from n""")
def re_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Customers track three exams: the first has a newer approved notice, the second needs no evaluation, the third's has no rules."""
    facts = R.applicant_facts(*people(spark, d))
    key = F.col("c_custkey")
    c = load(spark, d, "customer")
    tracked = c.select((key % 3 + 1).alias("exam_id"), key.alias("student_id"), F.when(key % 5 != 0, "ACTIVE").otherwise("INACTIVE").alias("tracking_status"))
    exams = spark.createDataFrame([(1, True), (2, False), (3, True)], "exam_id long, requires boolean")
    notices = spark.createDataFrame([(10, 1, "2026-01-01", "APPROVED"), (11, 1, None, "APPROVED"), (12, 1, "2026-05-01", "PENDING"), (20, 2, None, "APPROVED"), (30, 3, None, "APPROVED")], "notification_id long, exam_id long, release_date string, approval_status string").withColumn("release_date", F.col("release_date").cast("date"))
    groups = spark.createDataFrame([(10, 1, None, 1, "OR"), (11, 2, None, 1, "AND"), (12, 3, None, 1, "AND")], "notice long, group_id long, parent_group_id long, group_number int, logical_operator string")
    rules = spark.createDataFrame([(1, 1, "CGPA", ">=", "100000", "numeric"), (2, 1, "Nationality", "=", "Building", "text"), (3, 2, "CGPA", ">", "0", "numeric"), (4, 3, "CGPA", ">", "0", "numeric")], "rule_id long, group_id long, attribute string, operator string, value string, data_type string")
    status = F.when(key % 4 == 1, "ELIGIBLE").otherwise("NOT_ELIGIBLE")
    past = lambda n, at, s: c.where(key % 4 != 0).select((key * 2 + n).alias("eligibility_id"), key.alias("student_id"), (key % 3 + 1).alias("exam_id"), s.alias("status"), F.lit(at).cast("timestamp_ntz").alias("evaluated_at"))
    history = past(0, "2026-02-01 00:00:00", F.lit("UNKNOWN")).unionByName(past(1, "2026-03-01 00:00:00", status))
    return R.re_evaluate(exams, tracked, facts, notices, groups, rules, history).drop("reason", "eval_error")
