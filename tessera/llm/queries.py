"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op3_decontamination
from .divergence import op13_divergence
from .exact_dedup import op4_exact_dedup
from .jaccard_join import op8_jaccard_join
from .language_id import op6_language_id
from .mixing import op9_mixing
from .packing import op12_packing
from .periodic_runs import op11_periodic_runs
from .ppm_scoring import op7_lm_scoring
from .secrets import op2_secrets
from .sharding import op10_sharding
from .token_counts import op1_token_counts
from .toxicity import op5_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_secrets": op2_secrets,
    "op3_decontamination": op3_decontamination,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_packing": op12_packing,
    "op13_divergence": op13_divergence,
}

_KEYS = "(password|passwd|secret|token|api_?key)"


def _kind(n: int, kind: str, pattern: str, fits: str) -> str:
    return f"""
select doc_id, {n} as k, '{kind}' as kind,
       list_sum(list_transform(pieces[1:i - 1], lambda x: length(x))) as s,
       list_sum(list_transform(pieces[1:i], lambda x: length(x))) as e
from (select doc_id, pieces, unnest(generate_series(2, len(pieces), 2)) as i
      from (select doc_id, string_split(regexp_replace(translate(coalesce(text, ''), chr(64976), chr(1)), '{pattern}', chr(64976) || '\\0' || chr(64976), 'g'), chr(64976)) as pieces
            from documents))
where {fits}"""


ORACLE: dict[str, str] = {
    "op2_secrets": f"""
with found as (
{_kind(0, "assign", _KEYS.replace("(", "(?i:", 1) + '["'"''"']?\\x20*[:=]\\x20*["'"''"']?[A-Za-z0-9+/_.=-]+', "length(regexp_extract(pieces[i], '(?i:" + _KEYS[1:-1] + ")[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 8")}
union all {_kind(1, "access", "AKIA[A-Z0-9]+", "length(pieces[i]) >= 16")}
union all {_kind(2, "hex", "[0-9a-f]+", "length(pieces[i]) >= 32")}),
per as (
select doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
       string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, k) as spans
from found group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
       sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join per p on d.doc_id = p.doc_id""",
    "op4_exact_dedup": """
select doc_id, max(doc_id) over t as keep_id, count(*) over t as group_size, doc_id = max(doc_id) over t as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents window t as (partition by coalesce(text, ''))""",
    "op9_mixing": r"""
with docs as (
select doc_id, source, md5('9:' || doc_id || ':' || md5(coalesce(text, ''))) as place, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
from documents),
sources as (
select source, sum(size)::bigint as source_size, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as w
from docs group by source),
ends as (select *, source_size * 3.0::double as cap, source_size * 3.0::double / w as t from sources),
service as (
select *, ((select sum(source_size) from sources)::double - coalesce(sum(cap) over p, 0.0::double))
          / ((select sum(w) from ends) - coalesce(sum(w) over p, 0.0::double)) as v
from ends window p as (order by t, source nulls last rows between unbounded preceding and 1 preceding)),
targets as (select source, source_size, least(cap, w * (select v from service where v <= t order by t, v limit 1)) as target from service),
queue as (
select d.doc_id, d.size, g.source_size, g.target,
       sum(d.size) over (partition by d.source order by place, d.doc_id rows unbounded preceding)::bigint - d.size as start
from docs d join targets g on d.source is not distinct from g.source)
select doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target + 1e-6) - start))
        + greatest(0, least(size, floor(target + 1e-6) - start - source_size))
        + greatest(0, least(size, floor(target + 1e-6) - start - 2 * source_size)))::bigint as taken
from queue""",
    "op13_divergence": r"""
with docs as (
select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
from documents),
sources as (select distinct lang, source from docs),
words as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
counts as (select lang, source, term, count(*) as n, count(distinct r) as docs from words group by all),
kept as (select lang, term, sum(n)::bigint as n from counts group by all having sum(docs) >= 3),
langs as (select lang, count(*) + sum(n)::bigint as total from kept group by lang),
cells as (
select s.lang, s.source, k.term, k.n as in_lang, coalesce(c.n, 0) as n
from sources s join kept k on s.lang = k.lang left join counts c on c.lang = s.lang and c.source = s.source and c.term = k.term),
totals as (select lang, source, count(*) + sum(n)::bigint as total from cells group by all),
shares as (
select c.lang, c.source, c.term, c.n, 1 + 1000000000 * (c.n + 1) // t.total as p, 1 + 1000000000 * (c.in_lang + 1) // l.total as q
from cells c join totals t on c.lang = t.lang and c.source = t.source join langs l on c.lang = l.lang),
pairs as (
select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value
from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
parts as (
select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0) as value
from sources a join sources b on a.lang = b.lang and a.source <> b.source
left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
union all
select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // q)::bigint as value from shares where n > 0 and p > q),
ranked as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from parts)
select * from ranked where part = 'pair' or rank <= 200""",
}
