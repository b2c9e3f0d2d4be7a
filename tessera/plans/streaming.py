"""State- and time-driven queries: the batch replay of keyed state, and streams drained over the sample events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mutations as M
from ..operators import relational as R
from ..sources.tables import load, shared_folder
from ..streaming import fanout
from ..streaming import signup as U
from ..streaming import state as S
from ..streaming.drain import drained, event_stream
from ..streaming.sinks import append_once, batches, run_to_end
from .registry import query

_EVENTS = "e as (select user_id, event_id, epoch_us(ts) as us, value, row_number() over (partition by user_id order by ts, event_id) as rn from events)"
_DAY = 24 * 3600
_LIMITED = f"""
with recursive {_EVENTS},
walk as (
  select user_id, 0::bigint as rn, null::bigint as event_id, []::bigint[] as kept, false as accepted from (select distinct user_id from events)
  union all
  select e.user_id, e.rn, e.event_id, case when len(list_filter(w.kept, lambda k: e.us - k <= {_DAY}000000)) < 2 then list_append(list_filter(w.kept, lambda k: e.us - k <= {_DAY}000000), e.us) else list_filter(w.kept, lambda k: e.us - k <= {_DAY}000000) end,
         len(list_filter(w.kept, lambda k: e.us - k <= {_DAY}000000)) < 2
  from walk w join e on e.user_id = w.user_id and e.rn = w.rn + 1)
select user_id, event_id, accepted from walk where rn > 0"""


@query(_LIMITED)
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Two accepted events in a day for each user; rejected ones leave no trace."""
    return S.rate_limit(load(spark, d, "events"), "user_id", "event_id", "ts", 2, _DAY)


@query(_LIMITED)
def rate_limit_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same limiter over a stream of the events, one micro-batch for each file written in time order."""
    out = S.rate_limit_stream(event_stream(spark, d, 3), "user_id", "event_id", "ts", 2, _DAY)
    return drained(out, "append")


@query(f"""
with recursive {_EVENTS},
walk as (
  select user_id, 0::bigint as rn, null::bigint as event_id, 300.0::double as level, null::bigint as last, 0.0::double as wait, false as granted from (select distinct user_id from events)
  union all
  select user_id, rn, event_id, case when wait <= 3600.0 and cost <= 300 then lv - cost else lv end, us, wait, wait <= 3600.0 and cost <= 300 from (
    select e.user_id, e.rn, e.event_id, e.us, e.value as cost, case when w.last is null then w.level else least(300.0, w.level + (e.us / 1000000.0 - w.last / 1000000.0) * 0.001) end as lv,
           greatest(0.0, (e.value - case when w.last is null then w.level else least(300.0, w.level + (e.us / 1000000.0 - w.last / 1000000.0) * 0.001) end) / 0.001) as wait
    from walk w join e on e.user_id = w.user_id and e.rn = w.rn + 1))
select user_id, event_id, round(wait, 0) as wait, granted from walk where rn > 0""")
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    """A bucket of 300 that refills by one in 1,000 s; an event costs its value and waits an hour at most."""
    found = S.token_bucket(load(spark, d, "events"), "user_id", "event_id", "ts", "value", 3600.0, 300.0, 0.001)
    return found.withColumn("wait", F.round("wait", 0))


@query("select time_bucket(interval 6 hours, ts) as starts, event_type, count(*) as n from events group by all")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = S.windowed_counts(event_stream(spark, d, 4), "ts", "6 hours", "1 hour", "event_type")
    flat = counts.select(F.col("window.start").alias("starts"), "event_type", "n")
    return drained(flat, "update", ["starts", "event_type"], "n").withColumn("starts", F.col("starts").cast("timestamp_ntz"))


@query("select user_id, event_type from events group by all")
def dedupe_stream(spark: SparkSession, d: str) -> DataFrame:
    events = event_stream(spark, d, 2).withColumn("k", F.concat_ws(":", "user_id", "event_type"))
    return drained(S.dedupe_stream(events, "k", "ts", "60 days").select("user_id", "event_type"), "append")


@query("""
with tracked as (select distinct o_custkey, c_mktsegment from orders join customer on c_custkey = o_custkey where o_orderstatus = 'F')
select o_custkey as student_id, p_partkey as exam_id, 'new_exam:' || o_custkey || ':' || p_partkey as dedupe_key
from tracked, part where p_partkey < 3 and c_mktsegment <> 'MACHINERY' and not (o_custkey % 10 = 0 and p_partkey = 1)""")
def fanout_new(spark: SparkSession, d: str) -> DataFrame:
    """Two new notices to every eligible, active applicant that has not been told yet."""
    active = load(spark, d, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("student_id"))
    eligible = load(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("student_id")).distinct()
    exams = load(spark, d, "part").where("p_partkey < 3").select(F.col("p_partkey").alias("exam_id"))
    verdicts = eligible.withColumn("exam_id", F.explode(F.array(*[F.lit(i) for i in range(3)]).cast("array<long>"))).join(exams, "exam_id", "left_semi")
    told = active.where("student_id % 10 = 0").select(F.concat_ws(":", F.lit("new_exam"), "student_id", F.lit(1)).alias("dedupe_key"))
    return fanout.notices(verdicts, active, told, "new_exam").select("student_id", "exam_id", "dedupe_key")


@query("""
select user_id as student_id, ts::date as day, left('Details changed: ' || event_type || repeat('.', 1200), 1000) as message from events where event_type in ('error', 'signup') and user_id in (select o_custkey from orders where o_orderstatus = 'O')""")
def fanout_update(spark: SparkSession, d: str) -> DataFrame:
    tracking = load(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("student_id"))
    events = load(spark, d, "events").where("event_type in ('error', 'signup')").withColumnRenamed("user_id", "student_id")
    message = F.concat(F.lit("Details changed: "), "event_type", F.repeat(F.lit("."), F.lit(1200)))
    return fanout.updates(events, tracking, message).select("student_id", F.col("ts").cast("date").alias("day"), "message")


@query("""
select event_id, user_id, case event_type when 'signup' then 'ELIGIBLE' when 'error' then 'NOT_ELIGIBLE' else 'UNKNOWN' end as status
from (select *, lag(case event_type when 'signup' then 'ELIGIBLE' when 'error' then 'NOT_ELIGIBLE' else 'UNKNOWN' end) over (partition by user_id order by ts, event_id) as before from events)
where before is not null and before <> case event_type when 'signup' then 'ELIGIBLE' when 'error' then 'NOT_ELIGIBLE' else 'UNKNOWN' end""")
def fanout_flips(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "signup", "ELIGIBLE").when(F.col("event_type") == "error", "NOT_ELIGIBLE").otherwise("UNKNOWN")
    history = load(spark, d, "events").withColumn("status", status)
    return R.flips(history, "user_id", "status", "ts", "event_id").where("changed").select("event_id", "user_id", "status")


@query("""
select user_id, greatest(0, 600 - min(date_diff('second', date_trunc('second', ts), timestamp '2024-01-20 00:00:00')))::bigint as wait, count(*) filter (date_diff('second', date_trunc('second', ts), timestamp '2024-01-20 00:00:00') < 3600) >= 1 as used_up
from events where ts <= timestamp '2024-01-20 00:00:00' group by user_id""")
def send_gate(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events").where("ts <= timestamp_ntz'2024-01-20 00:00:00'").withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    return M.send_gate(events, "user_id", "ts", "2024-01-20 00:00:00", 600, 1)


# Requests: an event a minute or so for each user; signups start, every fifth other event asks for a new code, the rest verify.
_SIGN_UPS = """
with recursive r as (
select user_id, event_id, epoch_us(ts) // 600 as us, row_number() over (partition by user_id order by epoch_us(ts) // 600, event_id) as rn,
       case when event_type = 'signup' or event_id % 11 = 0 then 'start' when event_id % 5 = 0 then 'resend' else 'verify' end as action,
       (event_id // 7 % 9)::varchar as code, (event_id // 3 % 9)::varchar as fresh
from events),
walk as (
select user_id, 0::bigint as rn, null::bigint as event_id, false as has, false as registered, 0::bigint as expires, 0 as attempts, 0 as sends, 0::bigint as sent, 0::bigint as began, '' as code, '' as answer
from (select distinct user_id from events)
union all
select user_id, rn, event_id,
       case when answer = 'sent' then true when answer = 'locked' then false when action = 'verify' and answer = 'registered' then false else alive end,
       registered or (action = 'verify' and answer = 'registered'),
       case when answer = 'sent' then us + 600000000 else expires end,
       case when answer = 'sent' then 0 when answer like 'wrong%' then attempts + 1 else attempts end,
       case when answer = 'sent' then case when alive and (young or action = 'resend') then sends + 1 else 1 end else sends end,
       case when answer = 'sent' then us else sent end,
       case when answer = 'sent' and not (alive and (young or action = 'resend')) then us else began end,
       case when answer = 'sent' then fresh else code end,
       answer
from (
  select *, case
    when registered and action = 'start' then 'registered'
    when action = 'verify' then case when not alive then 'none' when expires < us then 'expired' when given = code then 'registered' when attempts = 4 then 'locked' else 'wrong:' || (4 - attempts) end
    when action = 'resend' and not alive then 'none'
    when alive and sent + 60000000 > us then 'wait:' || ((sent + 60000000 - us) // 1000000 + 1)
    when alive and young and sends >= 5 then 'too-many'
    else 'sent' end as answer
  from (
    select w.user_id, r.rn, r.event_id, r.us, r.action, r.code as given, r.fresh, w.has and not w.expires < r.us - 86400000000 as alive, w.registered, w.expires, w.attempts, w.sends, w.sent, w.began,
           w.code, w.began > r.us - 3600000000 as young
    from walk w join r on r.user_id = w.user_id and r.rn = w.rn + 1)))
select 'u' || user_id || '@x.org' as address, event_id as ident, answer from walk where rn > 0"""


def sign_up_requests(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    action = F.when((F.col("event_type") == "signup") | (k % 11 == 0), "start").when(k % 5 == 0, "resend").otherwise("verify")
    digit = lambda n: (F.floor(k / n) % 9).cast("string")
    at = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600).cast("long"))
    return events.select(F.concat(F.lit(" U"), "user_id", F.lit("@x.org")).alias("email"), "event_id", at.alias("at"), action.alias("action"), digit(7).alias("code"), digit(3).alias("fresh"))


_REQUEST = ("email", "event_id", "at", "action", "code", "fresh")


@query(_SIGN_UPS)
def sign_ups(spark: SparkSession, d: str) -> DataFrame:
    return U.sign_ups(sign_up_requests(load(spark, d, "events")), *_REQUEST)


@query(_SIGN_UPS)
def sign_ups_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same over a stream of the events."""
    return drained(U.sign_up_stream(sign_up_requests(event_stream(spark, d, 3)), *_REQUEST), "append")


@query("select user_id || ':' || event_type as dedupe_key, min(event_id) as event_id from (select *, rank() over (partition by user_id, event_type order by (epoch_us(ts) - a) * 3 // (b - a + 1)) as r from events, (select epoch_us(min(ts)) as a, epoch_us(max(ts)) as b from events)) where r = 1 group by all")
def notices_once(spark: SparkSession, d: str) -> DataFrame:
    """A notice for each user and kind of event out of a stream in three steps: stored once over all micro-batches, the least
    event of the first step that has one."""
    store, state = shared_folder(spark, "notices"), shared_folder(spark, "state")
    rows = event_stream(spark, d, 3).select("event_id", F.concat_ws(":", "user_id", "event_type").alias("dedupe_key"))
    run_to_end(rows, "append", state, lambda batch, number: append_once(batch, number, store, "dedupe_key"))
    return batches(spark, store).select("dedupe_key", "event_id")
