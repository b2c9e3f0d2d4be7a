"""Relational queries over the sample tables: customers are applicants, parts and suppliers exams and bodies, orders notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.tables import by_key, load, with_children
from .registry import query

DAY = "1998-06-01"


@query("select c_custkey, c_name, n_name from customer join nation on c_nationkey = n_nationkey where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def catalog_semi(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").where("o_orderstatus = 'F'")
    found = R.with_any(load(spark, d, "customer"), orders, "c_custkey", "o_custkey")
    return found.join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name").orderBy("c_name")


@query("select p_partkey, p_name, p_type from part where p_name ilike '%an%' or p_type ilike '%an%'")
def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").where(R.contains_ci(" an ", "p_name", "p_type")).select("p_partkey", "p_name", "p_type")


@query("select * from customer where c_custkey = 42")
def key_lookup(spark: SparkSession, d: str) -> DataFrame:
    return by_key(load(spark, d, "customer"), "c_custkey", 42)


@query("select o_orderkey, o_custkey from orders where o_custkey = 7 and o_orderstatus = 'O'")
def equality_conjunction(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").where("o_custkey = 7 and o_orderstatus = 'O'").select("o_orderkey", "o_custkey")


@query(f"select o_orderkey, o_orderdate::date as day from orders where o_orderdate >= date '{DAY}' and o_orderdate::date <= date '{DAY}' + interval 7 day")
def deadline_window(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return load(spark, d, "orders").where(day.isNotNull() & day.between(F.lit(DAY).cast("date"), F.date_add(F.lit(DAY).cast("date"), 7))).select("o_orderkey", day.alias("day"))


@query("select s_suppkey, s_name from supplier where s_nationkey in (1, 3, 5) and s_acctbal is not null")
def in_list(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "supplier").where(F.col("s_nationkey").isin(1, 3, 5) & F.col("s_acctbal").isNotNull()).select("s_suppkey", "s_name")


@query("select c_custkey, lower(coalesce(nullif(c_mktsegment, 'BUILDING'), '')) as status from customer where lower(coalesce(nullif(c_mktsegment, 'BUILDING'), '')) not in ('machinery', 'furniture')")
def active_not_blocked(spark: SparkSession, d: str) -> DataFrame:
    status = F.lower(F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("")))
    return load(spark, d, "customer").where(~status.isin("machinery", "furniture")).select("c_custkey", status.alias("status"))


@query("select o_orderkey from orders where (nullif(o_orderstatus, 'P') = 'F') is distinct from true")
def distinct_from_true(spark: SparkSession, d: str) -> DataFrame:
    flag = F.nullif("o_orderstatus", F.lit("P")) == "F"
    return load(spark, d, "orders").where(~flag.eqNullSafe(F.lit(True))).select("o_orderkey")


@query("select n_nationkey, n_name from nation where lower(trim(n_name)) = 'nation_7' or lower(n_name) = lower('NATION_3')")
def name_lookup(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").where((F.lower(F.trim("n_name")) == "nation_7") | (F.lower("n_name") == F.lower(F.lit("NATION_3")))).select("n_nationkey", "n_name")


@query("select c_custkey, c_name like '%7' as ends_seven, c_acctbal is not null as has_balance from customer")
def computed_booleans(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select("c_custkey", F.col("c_name").like("%7").alias("ends_seven"), F.col("c_acctbal").isNotNull().alias("has_balance"))


@query("select event_id, case when event_type like '%click%' then 'action' when event_type like '%view%' then 'seen' when event_type like '%purchase%' then 'paid' else 'other' end as bucket from events")
def type_bucket(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    bucket = F.when(kind.contains("click"), "action").when(kind.contains("view"), "seen").when(kind.contains("purchase"), "paid").otherwise("other")
    return load(spark, d, "events").select("event_id", bucket.alias("bucket"))


@query("select o_orderkey, l_linenumber, l_partkey, p_brand from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where o_orderstatus = 'P'")
def two_hop_join(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").where("o_orderstatus = 'P'")
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    found = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).join(load(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return found.select("o_orderkey", "l_linenumber", "l_partkey", "p_brand")


@query("""
with o as (select o_orderkey, o_custkey, case when o_orderstatus = 'P' then null else o_orderdate end as moment, o_orderstatus from orders)
select o_custkey, o_orderkey, moment::date as day from (select *, row_number() over (partition by o_custkey order by moment desc nulls last, o_orderkey desc) as rn from o) where rn = 1""")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("at"))
    return R.latest(orders, "o_custkey", F.col("at"), "o_orderkey").select("o_custkey", "o_orderkey", F.col("at").cast("date").alias("day"))


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as rn from orders) where rn = 1 and o_orderstatus = 'F'")
def rank_then_filter(spark: SparkSession, d: str) -> DataFrame:
    return R.last_then(load(spark, d, "orders"), "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey")


@query("select o_custkey, max(o_orderkey) as o_orderkey from orders where o_orderstatus = 'F' group by o_custkey")
def filter_then_rank(spark: SparkSession, d: str) -> DataFrame:
    return R.last_of(load(spark, d, "orders"), "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey")


@query("select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::bigint as version from orders")
def version_numbers(spark: SparkSession, d: str) -> DataFrame:
    found = R.versions(load(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    return found.select("o_orderkey", "o_custkey", F.col("version").cast("long").alias("version"))


@query("select event_id, user_id, lag(event_type) over w as previous, coalesce(lag(event_type) over w <> event_type, false) as changed from events window w as (partition by user_id order by ts, event_id)")
def status_flips(spark: SparkSession, d: str) -> DataFrame:
    return R.flips(load(spark, d, "events"), "user_id", "event_type", "ts", "event_id").select("event_id", "user_id", "previous", "changed")


@query("select count(*) filter (changed) as flipped, count(*) filter (not changed) as same from (select coalesce(lag(event_type) over (partition by user_id order by ts, event_id) <> event_type, false) as changed from events)")
def flip_counts(spark: SparkSession, d: str) -> DataFrame:
    found = R.flips(load(spark, d, "events"), "user_id", "event_type", "ts", "event_id")
    return found.agg(*R.count_by({"flipped": F.col("changed"), "same": ~F.col("changed")}))


@query("select o_orderkey, o_orderstatus, c_name, n_name from orders join customer on c_custkey = o_custkey left join (select * from nation where n_regionkey < 2) on n_nationkey = c_nationkey order by o_orderkey desc limit 50 offset 100")
def log_page(spark: SparkSession, d: str) -> DataFrame:
    joined = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    joined = joined.join(load(spark, d, "nation").where("n_regionkey < 2"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return R.page(joined, 100, 50, F.col("o_orderkey").desc()).select("o_orderkey", "o_orderstatus", "c_name", "n_name")


@query("select count(*) as total, count(*) filter (s = 'O') as open, count(*) filter (s = 'F') as done, count(*) filter (s is null) as none from (select nullif(o_orderstatus, 'P') as s from orders)")
def status_summary(spark: SparkSession, d: str) -> DataFrame:
    s = F.nullif("o_orderstatus", F.lit("P"))
    return load(spark, d, "orders").agg(F.count("*").alias("total"), *R.count_by({"open": s == "O", "done": s == "F", "none": s.isNull()}))


@query(" union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in ("region", "nation", "customer", "orders", "events", "documents")))
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = [load(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("region", "nation", "customer", "orders", "events", "documents")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("select n_nationkey, n_name, (select count(*) from supplier where s_nationkey = n_nationkey) as suppliers from nation")
def body_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    return load(spark, d, "nation").join(counts, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("c", F.lit(0)).alias("suppliers"))


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey < 12))")
def delete_cascade_survivors(spark: SparkSession, d: str) -> DataFrame:
    gone = R.with_any(load(spark, d, "orders"), load(spark, d, "customer").where("c_nationkey < 12"), "o_custkey", "c_custkey")
    return R.without_any(load(spark, d, "lineitem"), gone, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and quality = 1)")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    return R.without_any(load(spark, d, "documents").select("doc_id", "source"), load(spark, d, "labels").where("quality = 1"), "doc_id", "doc_id")


@query(f"""
with e as (select distinct on (user_id) user_id, event_type from events order by user_id, ts desc, event_id desc)
select o_orderkey, date_diff('day', date '{DAY}', o_orderdate::date)::bigint as days_left,
       case when date_diff('day', date '{DAY}', o_orderdate::date) <= 1 then 1 when date_diff('day', date '{DAY}', o_orderdate::date) <= 3 then 3 else 7 end as tier,
       'deadline:' || o_custkey || ':' || o_orderkey || ':' || case when date_diff('day', date '{DAY}', o_orderdate::date) <= 1 then 1 when date_diff('day', date '{DAY}', o_orderdate::date) <= 3 then 3 else 7 end as dedupe_key
from orders left join e on user_id = o_custkey
where o_orderdate::date between date '{DAY}' and date '{DAY}' + 7 and event_type is distinct from 'click'""")
def deadline_tiers(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.deadlines import reminders

    events = load(spark, d, "events")
    status = R.latest(events.select("user_id", "event_type", "ts", "event_id"), "user_id", F.col("ts"), "event_id")
    notices = load(spark, d, "orders").select(F.col("o_custkey").alias("student_id"), F.col("o_orderkey").alias("notification_id"), F.col("o_orderdate").cast("date").alias("deadline"))
    status = status.select(F.col("user_id").alias("student_id"), F.col("event_type").alias("status"))
    out = reminders(notices, status, DAY, 7, "click")
    return out.select(F.col("notification_id").alias("o_orderkey"), "days_left", "tier", "dedupe_key")


@query("""
with new as (select event_id, case when event_type = 'view' then null else user_id || ':' || event_type end as k from events where event_id % 2 = 1),
old as (select user_id || ':' || event_type as k from events where event_id % 2 = 0 and event_type <> 'view')
select event_id, k as dedupe_key from (select *, row_number() over (partition by k order by event_id) as rn from new) where k is null or (rn = 1 and k not in (select k from old))""")
def dedupe_insert(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    key = F.when(F.col("event_type") != "view", F.concat_ws(":", "user_id", "event_type"))
    rows = events.select("event_id", key.alias("dedupe_key"))
    return R.dedupe_insert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "dedupe_key", "event_id")


@query("select c_custkey, list_sort(coalesce(list(o_orderkey) filter (o_orderkey is not null), [])) as order_keys from customer left join orders on o_custkey = c_custkey group by c_custkey")
def eager_children(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    found = with_children(load(spark, d, "customer").select("c_custkey"), orders, "c_custkey", "orders", "o_orderkey")
    return found.select("c_custkey", F.col("orders.o_orderkey").alias("order_keys"))


@query("select o_orderkey, o_orderdate::date as day from orders where o_orderdate::date >= date '2001-07-20' order by day, o_orderkey limit 4")
def next_deadlines(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return load(spark, d, "orders").select("o_orderkey", day.alias("day")).where("day >= date'2001-07-20'").orderBy("day", "o_orderkey").limit(4)


@query("""
select o_orderkey, kind, day from (
select o_orderkey, 'opens' as kind, o_orderdate::date as day from orders union all
select o_orderkey, 'closes', (o_orderdate + interval 30 day)::date from orders where o_orderstatus = 'O') where day >= date '2001-07-01'""")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").withColumn("ends", F.when(F.col("o_orderstatus") == "O", F.date_add(F.col("o_orderdate").cast("date"), 30)))
    return R.unpivot_timeline(orders, "o_orderkey", {"opens": "o_orderdate", "closes": "ends"}, "2001-07-01")


@query("select event_id, user_id, ts from events order by ts desc, event_id desc limit 50")
def latest_fifty(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", "user_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query("""
with o as (select distinct o_custkey from orders where o_orderdate < timestamp '1998-01-01'), n as (select distinct o_custkey from orders where o_orderdate >= timestamp '1998-01-01')
select coalesce(o.o_custkey, n.o_custkey) as o_custkey, case when o.o_custkey is null then 'ADDED' when n.o_custkey is null then 'REMOVED' else 'COMMON' end as change from o full join n on o.o_custkey = n.o_custkey""")
def key_difference(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders")
    return R.key_difference(orders.where("o_orderdate < timestamp_ntz'1998-01-01 00:00:00'"), orders.where("o_orderdate >= timestamp_ntz'1998-01-01 00:00:00'"), "o_custkey")


@query("select o_custkey, count(*) filter (o_orderstatus = 'F') as n_done, min(o_orderdate)::date as first_day, string_agg(o_orderstatus, '\n' order by o_orderkey) as reasons from orders group by o_custkey")
def first_date_and_reasons(spark: SparkSession, d: str) -> DataFrame:
    reasons = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda s: s["o_orderstatus"]), "\n")
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_done"), F.min(F.col("o_orderdate").cast("date")).alias("first_day"), reasons.alias("reasons"))


@query("""
select p_partkey, l_orderkey as latest_order from part left join (select l_partkey, max(l_orderkey) as l_orderkey from lineitem group by l_partkey) on l_partkey = p_partkey""")
def left_latest(spark: SparkSession, d: str) -> DataFrame:
    newest = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_orderkey").alias("latest_order"))
    return load(spark, d, "part").select("p_partkey").join(newest, "p_partkey", "left")


@query("""
with a as (select user_id, event_type, ts, row_number() over (partition by user_id, event_type order by ts, event_id) as i from events where event_id % 2 = 0),
b as (select user_id, event_type, row_number() over (partition by user_id, event_type order by ts, event_id) as i from events where event_id % 2 = 1)
select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.event_type, b.event_type) as event_type, coalesce(a.i, b.i)::bigint as i,
case when a.user_id is null then 'ADDED' when b.user_id is null then 'REMOVED' else 'MATCHED' end as change
from a full join b on a.user_id = b.user_id and a.event_type = b.event_type and a.i = b.i""")
def occurrence_match(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.changes import match_occurrences

    events = load(spark, d, "events")
    return match_occurrences(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id", "event_type"], ["ts", "event_id"])
