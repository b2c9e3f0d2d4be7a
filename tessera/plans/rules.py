"""Rule-engine queries: customers are applicants, one literal notice with a nested rule tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules as R
from ..sources.tables import load
from .registry import query

#: (notice, group_id, parent_group_id, group_number, logical_operator)
GROUPS = [(1, 10, None, 1, "AND"), (1, 11, 10, 1, "OR"), (1, 12, 10, 2, "AND"), (1, 13, None, 2, "OR"), (2, 20, None, 1, "AND"), (3, 30, None, 1, "AND"), (3, 31, 30, 1, "AND")]
#: (rule_id, group_id, attribute, operator, value, data_type)
RULES = [
    (1, 10, "Percentage", ">=", "1000", "numeric"),
    (2, 11, "Nationality", "=", "NATION_3", "text"),
    (3, 11, "Nationality", "=", "NATION_7", "text"),
    (4, 11, "State", "=", "BUILDING", "text"),
    (5, 13, "State", "!=", "MACHINERY", "text"),
    (6, 13, "Date of Birth", ">=", "1993-08-02", "date"),
    (7, 20, "CGPA", ">", "5000", "numeric"),
    (8, 20, "Specialization", "=", "Physics", "text"),
]
_G = "notice long, group_id long, parent_group_id long, group_number int, logical_operator string"
_R = "rule_id long, group_id long, attribute string, operator string, value string, data_type string"


def literal(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(GROUPS, _G), spark.createDataFrame(RULES, _R)


def applicants(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    facts = {
        "nationality": F.col("n_name"),
        "state": F.col("c_mktsegment"),
        "percentage": F.col("c_acctbal"),
        "cgpa": F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")),
        "date of birth": F.date_add(F.lit("1990-01-01").cast("date"), (F.col("c_custkey") % 3000).cast("int")),
    }
    pairs = [x for k, v in facts.items() for x in (F.lit(k), v.cast("string"))]
    return c.select(F.col("c_custkey").alias("student_id"), F.create_map(*pairs).alias("facts"), F.array().cast("array<string>").alias("work"))


def evaluated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    groups, rules = literal(spark)
    pairs = applicants(spark, d).withColumn("notice", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)).cast("array<long>")))
    return pairs, R.evaluate(pairs, groups, rules)


_LEAVES = """
c as (select c_custkey, n_name, c_mktsegment as seg, c_acctbal as bal, case when c_custkey % 5 <> 0 then c_acctbal end as cgpa, date '1990-01-01' + (c_custkey % 3000)::int as dob from customer join nation on c_nationkey = n_nationkey),
l as (select c_custkey, bal >= 1000 as r1, n_name = 'NATION_3' as r2, n_name = 'NATION_7' as r3, seg = 'BUILDING' as r4, seg <> 'MACHINERY' as r5, dob >= date '1993-08-02' as r6, coalesce(cgpa > 5000, false) as r7, cgpa is null as m7, false as r8 from c),
v as (select *, r1 and (r2 or r3 or r4) as g10, r5 or r6 as g13 from l)"""
_FAIL = "'Requirement not satisfied: "


@query(f"""
with {_LEAVES}
select c_custkey as student_id, 1::bigint as notice, g10 and g13 as eligible from v
union all select c_custkey, 2, r7 and r8 from v""")
def rules_eval(spark: SparkSession, d: str) -> DataFrame:
    return evaluated(spark, d)[1].select("student_id", "notice", "eligible")


@query(f"""
with {_LEAVES}
select c_custkey as student_id, 1::bigint as notice,
  case when g10 and g13 then 'All applicable eligibility requirements were satisfied.' else array_to_string(list_filter([
    case when not g10 and not r1 then {_FAIL}Percentage >= 1000' end,
    case when not g10 and not (r2 or r3 or r4) then {_FAIL}Nationality = NATION_3' end,
    case when not g10 and not (r2 or r3 or r4) then {_FAIL}Nationality = NATION_7' end,
    case when not g10 and not (r2 or r3 or r4) then {_FAIL}State = BUILDING' end,
    case when not g13 then {_FAIL}State != MACHINERY' end,
    case when not g13 then {_FAIL}Date of Birth >= 1993-08-02' end], lambda x: x is not null), '|') end as reasons from v
union all
select c_custkey, 2, array_to_string(list_filter([case when not r7 then {_FAIL}CGPA > 5000' || case when m7 then ' (add this to your profile)' else '' end end,
   {_FAIL}Specialization = Physics (add this to your profile)'], lambda x: x is not null), '|') from v""")
def rules_reasons(spark: SparkSession, d: str) -> DataFrame:
    return evaluated(spark, d)[1].select("student_id", "notice", F.array_join("reasons", "|").alias("reasons"))


@query(f"""
with {_LEAVES}
select c_custkey as student_id, 1::bigint as notice, case when g10 and g13 then 'ELIGIBLE' else 'NOT_ELIGIBLE' end as status from v
union all select c_custkey, 2, case when r7 and r8 then 'ELIGIBLE' else 'NOT_ELIGIBLE' end from v
union all select c_custkey, 3, 'UNKNOWN' from v""")
def rules_status(spark: SparkSession, d: str) -> DataFrame:
    pairs, found = evaluated(spark, d)
    return R.status(pairs, found).select("student_id", "notice", "status")


@query("""
with n as (select o_custkey, o_orderkey, o_orderdate from orders where o_orderstatus = 'F'),
last as (select * from (select *, row_number() over (partition by o_custkey order by o_orderdate desc nulls last, o_orderkey desc) as r from n) where r = 1)
select c_custkey as student_id, o_orderkey as notice, c_acctbal >= 2000 as eligible from customer join last on o_custkey = c_custkey""")
def rules_latest_notice(spark: SparkSession, d: str) -> DataFrame:
    """Each customer against the rules of its latest finished order: one rule on the balance, by notice."""
    from ..operators.relational import latest

    orders = load(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "o_orderdate")
    newest = latest(orders, "o_custkey", F.col("o_orderdate"), "o_orderkey").select(F.col("o_custkey").alias("student_id"), F.col("o_orderkey").alias("notice"))
    pairs = applicants(spark, d).join(newest, "student_id")
    groups = newest.select("notice", F.col("notice").alias("group_id"), F.lit(None).cast("long").alias("parent_group_id"), F.lit(1).alias("group_number"), F.lit("AND").alias("logical_operator"))
    rules = newest.select(F.lit(1).cast("long").alias("rule_id"), F.col("notice").alias("group_id"), F.lit("Percentage").alias("attribute"), F.lit(">=").alias("operator"), F.lit("2000").alias("value"), F.lit("numeric").alias("data_type"))
    return R.evaluate(pairs, groups, rules).select("student_id", "notice", "eligible")
