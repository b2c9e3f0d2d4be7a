"""Monitoring queries: conversations are watched documents, their turns pages; injected functions fail on some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import callables as C
from ..operators import monitoring as M
from ..sources import blobs
from ..sources.tables import load, shared_folder
from .registry import query


def parse_page(text: str) -> str:
    if len(text) % 7 == 0:
        raise ValueError("page")
    return text


def extract_document(text: str) -> dict:
    if len(text) % 5 == 0:
        raise RuntimeError("no model")
    if len(text) % 11 == 0:
        return {"pages": "many"}
    return {"pages": text.count("\f") + 1, "eligibility_rules": len(text) // 100}


_PAGES = r"""
p as (select conv_id, turn, case when length(text) % 7 = 0 then '' else text end as text, length(text) % 7 = 0 as failed from conversations),
d as (
select conv_id, string_agg(text, chr(12) order by turn) as text, count(*) as pages, count(*) filter (regexp_matches(text, '\S')) as pages_with_text, count(*) filter (failed) as pages_failed
from p group by conv_id)"""


def pages_of(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").select(F.col("conv_id").alias("notification_id"), F.col("turn").alias("page_no"), F.col("text").alias("content"))


@query(f"""
with {_PAGES}
select conv_id as notification_id, length(text) as characters, pages, pages_with_text, pages_failed, case when pages_with_text = 0 then 'The document contains no extractable text.' end as error from d""")
def parsed_documents(spark: SparkSession, d: str) -> DataFrame:
    found = M.parsed_documents(pages_of(spark, d), "notification_id", "page_no", "content", parse_page)
    return found.select("notification_id", F.length("text").cast("long").alias("characters"), "pages", "pages_with_text", "pages_failed", "error")


_CYCLE = f"""
{_PAGES},
n as (
select *, sha256(text) as now, case when conv_id % 3 = 0 then sha256(text) else 'x' end as before, pages + conv_id % 2 as old_pages, length(text) // 100 + (case when conv_id % 4 = 0 then 1 else 0 end) as old_rules
from d where conv_id % 5 <> 4),
e as (
select *, case when pages_with_text = 0 then 'The document contains no extractable text.' when now = before then null when length(text) % 5 = 0 then 'RuntimeError: no model'
            when length(text) % 11 = 0 then 'ValueError: result.pages: bigint is wanted' end as error,
       (case when old_pages <> pages then 1 else 0 end + case when old_rules <> length(text) // 100 then 1 else 0 end)::bigint as n, old_rules <> length(text) // 100 as rules
from n),
cycle as (
select conv_id as notification_id, case when error is null then 'SUCCESS' else 'FAILED' end as status, error,
       case when error is null then case when now = before then 'NO_CHANGE' else 'CHANGE_DETECTED' end end as outcome, case when error is null then now <> before end as changed,
       case when error is null then before end as previous_hash, case when error is null then now end as current_hash,
       case when error is null and now <> before then n end as change_count, case when error is null and now <> before then n > 0 end as requires_human_review,
       case when error is null and now <> before then rules end as requires_eligibility_re_evaluation
from e)"""


def cycle(spark: SparkSession, d: str) -> DataFrame:
    pages, key = pages_of(spark, d), F.col("notification_id")
    text = F.when(F.length("content") % 7 == 0, "").otherwise(F.col("content"))
    placed = F.array_sort(F.collect_list(F.struct("page_no", text.alias("text"))))
    docs = pages.groupBy("notification_id").agg(F.array_join(F.transform(placed, lambda x: x["text"]), "\f").alias("text"), F.count("*").alias("n"))
    rules = F.floor(F.length("text") / 100) + F.when(key % 4 == 0, 1).otherwise(0)
    notices = docs.select(
        key,
        F.when(key % 3 == 0, F.sha2("text", 256)).otherwise("x").alias("document_hash"),
        F.to_json(F.struct((F.col("n") + key % 2).alias("pages"), rules.alias("eligibility_rules"))).alias("extraction"),
        F.when(key % 5 == 4, "PENDING").otherwise("APPROVED").alias("approval_status"),
    )
    return M.monitoring_cycle(notices, pages, parse_page, extract_document, "pages long, eligibility_rules long")


@query(f"with {_CYCLE} select * from cycle")
def monitoring_cycle(spark: SparkSession, d: str) -> DataFrame:
    return cycle(spark, d)


@query(f"with {_CYCLE} select count(*) as notifications_found, count(*) as notifications_processed, count(*) filter (status = 'SUCCESS') as successful, count(*) filter (status = 'FAILED') as failed from cycle")
def monitoring_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.cycle_summary(cycle(spark, d))


@query(f"""
with p as (select conv_id, turn, text, length(text) as n from conversations),
e as (select conv_id, arg_min(case when n % 5 = 0 then 'RuntimeError: no model' else 'ValueError: result.pages: bigint is wanted' end, turn) as error from p where n % 5 = 0 or n % 11 = 0 group by conv_id)
select p.conv_id, e.error, case when e.error is null then string_agg((n // 100)::varchar, ',' order by turn) end as results from p left join e on e.conv_id = p.conv_id group by p.conv_id, e.error""")
def ordered_answers(spark: SparkSession, d: str) -> DataFrame:
    """Every turn put to a function that fails on some and answers out of form on others: all answers or the first error."""
    answers = C.called(load(spark, d, "conversations"), "text", extract_document, "pages long not null, eligibility_rules long", keep=["conv_id", "turn"])
    found = C.in_order(answers, "conv_id", "turn")
    return found.select("conv_id", "error", F.array_join(F.transform("results", lambda r: r["eligibility_rules"].cast("string")), ",").alias("results"))


@query("""
with s as (select distinct sha256(text) as sha256 from documents where text <> '')
select sha256, (select count(*) from s) as written, 0::bigint as written_again from s""")
def stored_contents(spark: SparkSession, d: str) -> DataFrame:
    """All texts into a store by content, twice: what it holds and how many each run wrote."""
    store, texts = shared_folder(spark, "blobs"), load(spark, d, "documents").select("text")
    runs = [blobs.store_new(texts, "text", store) for _ in range(2)]
    return blobs.stored(spark, store).select("sha256", F.lit(runs[0]).cast("long").alias("written"), F.lit(runs[1]).cast("long").alias("written_again"))
