"""Change-detection queries: orders in two derived versions stand for two versions of a notice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import mutations as M
from ..sources.tables import load
from .registry import query

_VERSIONS = """
v1 as (select o_orderkey, o_orderstatus as status, o_orderpriority as priority, case when o_orderkey % 3 <> 0 then o_orderdate::date end as ends from orders),
v2 as (select o_orderkey, case when o_orderkey % 7 = 0 then 'F' else o_orderstatus end as status, case when o_orderkey % 5 <> 0 then o_orderpriority end as priority, case when o_orderkey % 4 <> 0 then o_orderdate::date end as ends from orders),
f1 as (select o_orderkey, 'eligibility_rules[0].status' as path, '"' || status || '"' as v from v1 where status is not null union all select o_orderkey, 'information.language', '"' || priority || '"' from v1 where priority is not null union all select o_orderkey, 'information.application_end_date', '"' || ends || '"' from v1 where ends is not null),
f2 as (select o_orderkey, 'eligibility_rules[0].status' as path, '"' || status || '"' as v from v2 where status is not null union all select o_orderkey, 'information.language', '"' || priority || '"' from v2 where priority is not null union all select o_orderkey, 'information.application_end_date', '"' || ends || '"' from v2 where ends is not null),
changed as (
select coalesce(f1.o_orderkey, f2.o_orderkey) as o_orderkey, coalesce(f1.path, f2.path) as path,
  case when f1.path is null then 'ADDED' when f2.path is null then 'REMOVED' else 'MODIFIED' end as change_type, f1.v as old, f2.v as new
from f1 full join f2 on f1.o_orderkey = f2.o_orderkey and f1.path = f2.path where f1.v is distinct from f2.v)"""


def two_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    orders = load(spark, d, "orders")
    names = ("eligibility_rules[0].status", "information.language", "information.application_end_date")
    old = (F.col("o_orderstatus"), F.col("o_orderpriority"), F.when(key % 3 != 0, day))
    new = (F.when(key % 7 == 0, "F").otherwise(F.col("o_orderstatus")), F.when(key % 5 != 0, F.col("o_orderpriority")), F.when(key % 4 != 0, day))
    return tuple(C.flatten_paths(orders, "o_orderkey", dict(zip(names, fields, strict=True))) for fields in (old, new))


@query(f"with {_VERSIONS} select * from changed")
def diff_rows(spark: SparkSession, d: str) -> DataFrame:
    return C.diff(*two_versions(spark, d), "o_orderkey")


@query(f"""
with {_VERSIONS}
select o_orderkey, count(*) as changes, bool_or(contains(path, 'eligibility_rules')) as eligibility_changed, bool_or(path like '%application_end_date') as timeline_changed,
       false as schedule_changed, bool_or(path like '%language') as other_changed, bool_or(contains(path, 'eligibility_rules')) as re_evaluate
from changed group by o_orderkey""")
def impact_rollup(spark: SparkSession, d: str) -> DataFrame:
    return C.impact_rollup(C.diff(*two_versions(spark, d), "o_orderkey"), "o_orderkey")


@query("""
select doc_id, sha256(case when doc_id % 10 = 0 then text || '!' else text end) as new_hash, case when doc_id % 13 = 0 then null else sha256(text) end as old_hash,
       case when doc_id % 13 <> 0 and doc_id % 10 <> 0 then 'NO_CHANGE' else 'CHANGE_DETECTED' end as status from documents""")
def hash_status(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "text")
    old = docs.where("doc_id % 13 <> 0").select("doc_id", F.sha2("text", 256).alias("hash"))
    new = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return C.hash_status(old, new, "doc_id")


@query("""
with o as (select l_orderkey, l_partkey, l_quantity as q, row_number() over (partition by l_orderkey, l_partkey order by l_linenumber, l_extendedprice) as i from lineitem where l_linenumber <> 3),
n as (select l_orderkey, l_partkey, case when l_linenumber = 2 then l_quantity + 1 else l_quantity end as q, row_number() over (partition by l_orderkey, l_partkey order by l_linenumber, l_extendedprice) as i from lineitem where l_linenumber <> 1)
select coalesce(o.l_orderkey, n.l_orderkey) as l_orderkey, coalesce(o.l_partkey, n.l_partkey) as l_partkey, coalesce(o.i, n.i)::bigint as i,
       case when o.i is null then 'ADDED' when n.i is null then 'REMOVED' else 'MODIFIED' end as change_type, o.q as old, n.q as new
from o full join n on o.l_orderkey = n.l_orderkey and o.l_partkey = n.l_partkey and o.i = n.i where o.q is distinct from n.q""")
def keyed_changes(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    old = lines.where("l_linenumber <> 3")
    new = lines.where("l_linenumber <> 1").withColumn("l_quantity", F.when(F.col("l_linenumber") == 2, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return C.keyed_changes(old, new, ["l_orderkey", "l_partkey"], ["l_linenumber", "l_extendedprice"], "l_quantity")


@query("""
select event_id, path, change_type, old, new from (
  select event_id, 'k' as path, 'MODIFIED' as change_type, json_extract(props, '$.k')::varchar as old, (json_extract(props, '$.k')::bigint + 1)::varchar as new from events where event_id % 3 = 0
  union all select event_id, 'seen[1].at', 'ADDED', null, '"' || event_type || '"' from events where event_id % 3 = 1
  union all select event_id, 'seen[0].at', 'REMOVED', '"' || event_type || '"', null from events where event_id % 3 = 2)""")
def nested_diff(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"), (F.col("event_id") % 3).alias("m"))
    at = F.concat(F.lit('{"at": "'), "event_type", F.lit('"}'))
    body = lambda k, items: F.concat(F.lit('{"k": '), k, F.lit(', "seen": ['), items, F.lit("]}"))
    more = F.when(F.col("m") == 0, (F.col("k").cast("long") + 1).cast("string")).otherwise(F.col("k"))
    items = F.when(F.col("m") == 1, F.concat(at, F.lit(","), at)).when(F.col("m") == 2, "").otherwise(at)
    old = C.flatten_json(events.select("event_id", body(F.col("k"), at).alias("json")), "event_id", "json")
    new = C.flatten_json(events.select("event_id", body(more, items).alias("json")), "event_id", "json")
    return C.diff(old, new, "event_id")


@query("""
select o_orderkey, case when o_orderstatus = 'P' and o_orderkey % 2 = 0 then 'F' when o_orderstatus = 'O' and o_orderkey % 2 = 1 then 'P' else o_orderstatus end as status from orders""")
def state_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Approve even orders and submit odd ones; only P -> F and O -> P are steps."""
    orders = load(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    asked = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "approve").otherwise("submit").alias("action"))
    return C.transition(orders, asked, "o_orderkey", "status", [("P", "approve", "F"), ("O", "submit", "P")])[0]


@query("select o_orderkey, case when o_orderkey % 2 = 0 then 'approve' else 'submit' end as action from orders where not ((o_orderstatus = 'P' and o_orderkey % 2 = 0) or (o_orderstatus = 'O' and o_orderkey % 2 = 1))")
def refused_transitions(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    asked = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "approve").otherwise("submit").alias("action"))
    return C.transition(orders, asked, "o_orderkey", "status", [("P", "approve", "F"), ("O", "submit", "P")])[1]


@query("""
with wanted as (select distinct lower(trim(p_name)) as key, min(p_name) as name from part group by 1), known as (select lower(p_name) as key, min(p_partkey) as id from part where p_partkey % 3 = 0 group by 1),
top as (select coalesce(max(id), 0) as m from known)
select w.name, coalesce(k.id, m + row_number() over (partition by k.id is null order by w.key)) as id, k.id is null as created from wanted w left join known k using (key), top""")
def get_or_create(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part")
    known = part.where("p_partkey % 3 = 0").groupBy(F.lower("p_name").alias("key")).agg(F.min("p_partkey").alias("id"))
    wanted = part.groupBy(F.lower(F.trim("p_name")).alias("key")).agg(F.min("p_name").alias("name"))
    return M.get_or_create(known, wanted, "key", "id").select("name", "id", "created")


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_nationkey < 10)")
def insert_checked(spark: SparkSession, d: str) -> DataFrame:
    parents = load(spark, d, "customer").where("c_nationkey < 10").select("c_custkey")
    return M.insert_checked(load(spark, d, "orders").select("o_orderkey", "o_custkey"), parents, "o_custkey", "c_custkey")[0]


@query("""
with active as (select distinct o_custkey from orders where o_orderstatus = 'F'), asked as (select o_custkey, min(o_orderkey) as o_orderkey from orders where o_orderstatus <> 'F' group by 1)
select a.o_custkey, a.o_orderkey from asked a where a.o_custkey not in (select o_custkey from active)""")
def unique_active(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    out = M.insert_unique_active(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'"), ["o_custkey"], F.lit(True), "o_orderkey")
    return out.select("o_custkey", "o_orderkey")


@query("select c_custkey, case when c_nationkey < 3 then 'INACTIVE' else 'ACTIVE' end as status, case when c_nationkey < 3 then 'BUILDING' else c_mktsegment end as segment from customer")
def overlay(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "customer").select("c_custkey", F.lit("ACTIVE").alias("status"), F.col("c_mktsegment").alias("segment"), "c_nationkey")
    patch = rows.where("c_nationkey < 3").select("c_custkey", F.lit("INACTIVE").alias("status"), F.lit("BUILDING").alias("segment"))
    return M.overlay(rows.drop("c_nationkey"), patch, "c_custkey")


@query("""
select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P')
union all select o_orderkey, 1, 0.0 from orders where o_orderstatus = 'P'""")
def replace_children(spark: SparkSession, d: str) -> DataFrame:
    old = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = load(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return M.replace_children(old, new, "l_orderkey")


@query("select event_id, user_id from events where ts >= timestamp '2024-01-20 00:00:00' - interval 1 day")
def purge_expired(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events").select("event_id", "user_id", "ts")
    return M.purge(events, "ts", "2024-01-20 00:00:00", "1 day").select("event_id", "user_id")


@query("""
select o_orderkey, o_custkey, case when o_orderstatus <> 'P' then 'not pending' when o_orderkey <> m then 'not the latest' else 'ok' end as verdict
from (select *, max(o_orderkey) over (partition by o_custkey) as m from orders)""")
def approval_guard(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return M.approval_guard(orders, "o_custkey", "o_orderkey", F.col("o_orderstatus") == "P").select("o_orderkey", "o_custkey", "verdict")


@query("""
select o_orderkey, 'orders' as entity_type, '{"status":"' || o_orderstatus || '"}' as old_value, '{"status":"F"}' as new_value from orders where o_orderstatus = 'P'""")
def audit_rows(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    edited = orders.withColumn("status", F.when(F.col("status") == "P", "F").otherwise(F.col("status")))
    return M.audit(orders, edited, "o_orderkey", "orders")


_REVIEW = """
a as (select c_custkey, case when c_custkey % 4 = 0 then 'APPROVED' else 'PENDING' end as status, c_mktsegment as hash from customer),
q as (select c_custkey, 1 as n, case when c_custkey % 3 = 0 then 'approve' else 'reject' end as action, case when c_custkey % 5 = 0 then ' ' else 'why' end as feedback, case when c_custkey % 7 = 0 then 'old' else c_mktsegment end as saw from customer
  union all select c_custkey, 2, 'approve', 'why', c_mktsegment from customer where c_custkey % 2 = 0),
f as (select q.*, status = 'PENDING' and (action <> 'reject' or trim(feedback) <> '') and saw = hash as fits from q join a using (c_custkey)),
t as (select *, fits and row_number() over (partition by c_custkey order by fits desc, n) = 1 as taken from f)"""


def reviews(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Reviews of customers, every fourth one settled; one or two requests for each, a rejection needs feedback, the hash must be the current one."""
    c, key = load(spark, d, "customer"), F.col("c_custkey")
    rows = c.select(key, F.when(key % 4 == 0, "APPROVED").otherwise("PENDING").alias("status"), F.col("c_mktsegment").alias("hash"))
    first = c.select(key, F.lit(1).alias("n"), F.when(key % 3 == 0, "approve").otherwise("reject").alias("action"), F.when(key % 5 == 0, " ").otherwise("why").alias("feedback"), F.when(key % 7 == 0, "old").otherwise(F.col("c_mktsegment")).alias("saw"))
    second = c.where(key % 2 == 0).select(key, F.lit(2).alias("n"), F.lit("approve").alias("action"), F.lit("why").alias("feedback"), F.col("c_mktsegment").alias("saw"))
    steps = [("PENDING", "approve", "APPROVED"), ("PENDING", "reject", "REJECTED")]
    return C.transition(rows, first.unionByName(second), "c_custkey", "status", steps, "n", {"reject": "feedback"}, ("saw", "hash"))


@query(f"with {_REVIEW} select c_custkey, coalesce((select case action when 'approve' then 'APPROVED' else 'REJECTED' end from t where taken and t.c_custkey = a.c_custkey), status) as status from a")
def review_decisions(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d)[0].select("c_custkey", "status")


@query(f"with {_REVIEW} select c_custkey, n, action from t where not taken")
def review_refusals(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d)[1].select("c_custkey", "n", "action")


@query("""
with asked as (select o_orderkey, o_custkey from orders where o_orderkey % 2 = 0), given as (select o_orderkey, o_custkey from orders where o_orderkey % 2 = 0 and o_orderkey % 6 <> 0 union all select o_orderkey, o_custkey from orders where o_orderkey % 10 = 0)
select o_custkey, bool_and(n = 1 and m = 1) as valid from (
  select coalesce(a.o_custkey, g.o_custkey) as o_custkey, coalesce(a.n, 0) as n, coalesce(g.n, 0) as m
  from (select o_custkey, o_orderkey, count(*) as n from asked group by all) a full join (select o_custkey, o_orderkey, count(*) as n from given group by all) g on a.o_orderkey = g.o_orderkey and a.o_custkey = g.o_custkey)
group by o_custkey""")
def mapping_check(spark: SparkSession, d: str) -> DataFrame:
    """An analyser has to answer every change exactly once; valid says whether it did, for each customer."""
    asked = load(spark, d, "orders").where("o_orderkey % 2 = 0").select("o_custkey", "o_orderkey")
    given = asked.where("o_orderkey % 6 <> 0").unionByName(asked.where("o_orderkey % 10 = 0"))
    return C.one_to_one(asked, given, "o_custkey", "o_orderkey")
