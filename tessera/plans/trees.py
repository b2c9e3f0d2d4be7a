"""Rule-tree queries over trees made of orders and their lines: a heap of lines (each line below the line of half its number,
two roots an order), or two levels (a group for each return flag, below it one for each line status)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import rules as R
from ..operators import trees as T
from ..sources.tables import load, materialise
from .registry import query

_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")

_HEAP = f"""
line as (select *, row_number() over (partition by l_orderkey order by {", ".join(_ORDER)})::int as n from lineitem),
g as (
select l_orderkey as notice, l_orderkey * 100 + n as group_id, case when n > 2 then l_orderkey * 100 + n // 2 end as parent_group_id,
       n as group_number, case l_linestatus when 'O' then 'AND' else 'OR' end as logical_operator
from line),
r as (
select l_orderkey * 1000 + n * 10 as rule_id, l_orderkey * 100 + n as group_id, 'CGPA' as attribute,
       case l_returnflag when 'A' then '>=' when 'N' then '<' else '=' end as operator, l_quantity::int::varchar as value
from line where l_linenumber % 3 <> 0
union all
select l_orderkey * 1000 + n * 10 + 1, l_orderkey * 100 + n, 'State', '=', case l_returnflag when 'R' then ' ' else l_returnflag end
from line where l_linenumber % 3 = 2)"""
_WALK = """
w as (
select notice, group_id, 0 as depth, [1000000 + group_number] as path, [group_id] as above from g where parent_group_id is null
union all
select g.notice, g.group_id, depth + 1, list_append(path, 1000000 + g.group_number), list_append(above, g.group_id)
from g join w on g.parent_group_id = w.group_id)"""


def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)))


def orders(spark: SparkSession, d: str) -> DataFrame:
    """(l_orderkey, lines), a row for each order, its lines in order, numbered: one shuffle, written once for all that reads them."""
    lines = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*_ORDER, "l_returnflag", "l_linestatus"))).alias("lines"))
    kept = ("l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    return materialise(lines.select("l_orderkey", F.transform("lines", lambda x, i: F.struct((i + 1).alias("n"), *[x[c].alias(c) for c in kept])).alias("lines")), "orders")


def heap(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = orders(spark, d).select("l_orderkey", F.inline("lines"))
    number = F.col("l_orderkey") * 100 + F.col("n")
    parent = F.when(F.col("n") > 2, F.col("l_orderkey") * 100 + F.floor(F.col("n") / 2))
    operator = F.when(F.col("l_linestatus") == "O", "AND").otherwise("OR")
    groups = lines.select(F.col("l_orderkey").alias("notice"), number.alias("group_id"), parent.alias("parent_group_id"), F.col("n").alias("group_number"), operator.alias("logical_operator"))
    mark = F.when(F.col("l_returnflag") == "A", ">=").when(F.col("l_returnflag") == "N", "<").otherwise("=")
    state = F.when(F.col("l_returnflag") == "R", " ").otherwise(F.col("l_returnflag"))

    def rule(i: int, attribute: str, op: Column, value: Column) -> Column:
        ident = F.col("l_orderkey") * 1000 + F.col("n") * 10 + i
        return F.struct(ident.alias("rule_id"), number.alias("group_id"), F.lit(attribute).alias("attribute"), op.alias("operator"), value.alias("value"))

    scores = F.when(F.col("l_linenumber") % 3 != 0, rule(0, "CGPA", mark, F.col("l_quantity").cast("int").cast("string")))
    states = F.when(F.col("l_linenumber") % 3 == 2, rule(1, "State", F.lit("="), state))
    return groups, lines.select(F.inline(F.array_compact(F.array(scores, states))))


@query(f"with recursive {_HEAP}, {_WALK} select a as group_id, count(r.rule_id) as n_rules from (select group_id, unnest(above) as a from w) c left join r on r.group_id = c.group_id group by a")
def rules_count(spark: SparkSession, d: str) -> DataFrame:
    return R.rule_counts(*heap(spark, d)).select("group_id", "n_rules")


@query(f"""
with recursive {_HEAP}, {_WALK},
lines as (
select w.notice, path, repeat('  ', depth) || logical_operator as line from w join g on w.group_id = g.group_id
union all
select w.notice, list_append(path, (r.rule_id % 10)::int), repeat('  ', depth + 1) || attribute || ' ' || operator || ' ' || value from w join r on w.group_id = r.group_id)
select notice, row_number() over (partition by notice order by path)::int as line_no, line from lines""")
def rules_outline(spark: SparkSession, d: str) -> DataFrame:
    return R.outline(*heap(spark, d))


@query(f"""
with recursive {_HEAP}, {_WALK},
k as (select * from r where trim(value) <> ''),
live as (
select * from g where group_id in (select a from (select group_id, unnest(above) as a from w) c join k on k.group_id = c.group_id)),
wrapper as (
select group_id from live where group_id not in (select group_id from k)
and (select count(*) from live x where x.parent_group_id = live.group_id) = 1),
up as (select group_id, unnest(above) as a, unnest(range(len(above))) as i from w)
select l.group_id, (select arg_max(a, i) from up where up.group_id = l.group_id and a <> l.group_id and a not in (select group_id from wrapper)) as parent_group_id
from live l where group_id not in (select group_id from wrapper)""")
def rules_simplify(spark: SparkSession, d: str) -> DataFrame:
    return R.simplify(*heap(spark, d))[0].select("group_id", "parent_group_id")


@query("""
with v as (
select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as rule_id, l_linenumber % 5 as k, l_returnflag as f, l_tax = 0 as odd,
       l_quantity as q, l_shipdate::date as day
from lineitem),
i as (
select rule_id, unnest([
  case when k = 0 then 'unknown-attribute' end,
  case when f = 'R' then 'unknown-operator' end,
  case when k = 2 and f = 'A' then 'operator-not-allowed' end,
  case when k = 2 and odd then 'empty-value' end,
  case when k in (1, 3) and odd then 'not-a-number' end,
  case when k = 1 and not odd and q > 10 then 'out-of-range' end,
  case when k = 3 and not odd and q * 4 > 100 then 'out-of-range' end,
  case when k = 4 and odd then 'not-a-date' end,
  case when k = 4 and not odd and day > date '1998-01-01' then 'future-date' end]) as issue from v)
select issue, count(*) as n, sum(hash_part) as rule_ids from (select issue, rule_id as hash_part from i where issue is not null) group by issue""")
def rules_validate(spark: SparkSession, d: str) -> DataFrame:
    """Each line as a rule that may have faults; by fault how many rules have it, and the sum of their numbers."""
    lines = T.numbered(load(spark, d, "lineitem"), ["l_orderkey", *_ORDER], "rule_id")
    k, odd = F.col("l_linenumber") % 5, F.col("l_tax") == 0
    amount = lambda times: F.when(odd, "many").otherwise((F.col("l_quantity") * times).cast("string"))
    day = F.when(odd, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    state = F.when(odd, "").otherwise(F.col("l_returnflag"))
    rules = lines.select(
        "rule_id",
        F.element_at(F.array(*map(F.lit, ("Height", "CGPA", "State", "Percentage", "Date of Birth"))), (k + 1).cast("int")).alias("attribute"),
        F.when(F.col("l_returnflag") == "A", ">=").when(F.col("l_returnflag") == "N", "=").otherwise("~").alias("operator"),
        F.when(k == 0, "3").when(k == 1, amount(1)).when(k == 2, state).when(k == 3, amount(4)).otherwise(day).alias("value"),
    )
    found = rules.select("rule_id", F.explode(R.leaf_issues("1998-01-01")).alias("issue"))
    return found.groupBy("issue").agg(F.count("*").alias("n"), F.sum("rule_id").cast("decimal(38,0)").alias("rule_ids"))


@query("""
with b as (
select l_orderkey * 10 + ascii(l_returnflag) % 10 as group_id, case l_linestatus when 'O' then 'cgpa' else 'percentage' end as attribute, l_quantity as v,
       ['>=', '<=', '>', '<', '='][l_linenumber % 5 + 1] as op
from lineitem where l_returnflag <> 'R'),
s as (
select group_id, attribute, max(v) filter (op in ('>', '>=')) as lo, max(v) filter (op = '>') as slo, min(v) filter (op in ('<', '<=')) as hi, min(v) filter (op = '<') as shi,
       min(v) filter (op = '=') as e, max(v) filter (op = '=') as e2
from b group by all)
select group_id, attribute from s
where e <> e2 or lo > hi or (lo = hi and (slo = lo or shi = hi)) or e < lo or (e = lo and slo = lo) or e > hi or (e = hi and shi = hi)""")
def rules_contradict(spark: SparkSession, d: str) -> DataFrame:
    """The lines of an order with one return flag as limits in one group, an OR group for flag R: which can't all hold."""
    lines = load(spark, d, "lineitem")
    number = F.col("l_orderkey") * 10 + F.ascii("l_returnflag") % 10
    groups = lines.select(number.alias("group_id"), F.when(F.col("l_returnflag") == "R", "OR").otherwise("AND").alias("logical_operator")).distinct()
    rules = lines.select(
        number.alias("group_id"),
        F.when(F.col("l_linestatus") == "O", "CGPA").otherwise("Percentage").alias("attribute"),
        F.element_at(F.array(*map(F.lit, (">=", "<=", ">", "<", "="))), (F.col("l_linenumber") % 5 + 1).cast("int")).alias("operator"),
        F.col("l_quantity").cast("string").alias("value"),
    )
    return R.contradictions(groups, rules, "double")


_LOST = f"""{_HEAP.replace("then l_orderkey * 100 + n // 2 end", "then l_orderkey * 100 + case n when 5 then 99 when 7 then 8 when 8 then 7 else n // 2 end end")}"""


@query(f"""
with recursive {_LOST}, {_WALK}
select notice, group_id, case when exists (select 1 from g p where p.notice = g.notice and p.group_id = g.parent_group_id) then 'detached' else 'missing-parent' end as issue
from g where group_id not in (select group_id from w)""")
def tree_issues(spark: SparkSession, d: str) -> DataFrame:
    """Groups without a way to a root: a parent that is not there, what hangs below it, a circle."""
    groups = heap(spark, d)[0]
    other = F.when(F.col("group_number") == 5, 99).when(F.col("group_number") == 7, 8).when(F.col("group_number") == 8, 7)
    return R.tree_issues(groups.withColumn("parent_group_id", F.coalesce(F.col("notice") * 100 + other, "parent_group_id")))


_TEXTS = """
t as (
select group_id, '[' || string_agg('{"attribute":"' || attribute || '","operator":"' || operator || '","value":"' || value || '"}', ',' order by rule_id) || ']' as texts
from r group by group_id)"""


@query(f"""
with recursive {_HEAP}, {_WALK}, {_TEXTS},
p as (
select w.notice, path, depth, lag(depth) over (partition by w.notice order by path) as d,
       '{{"logical_operator":"' || logical_operator || '","rules":' || coalesce(texts, '[]') || ',"child_groups":[' as head
from w join g on w.group_id = g.group_id left join t on t.group_id = w.group_id)
select notice, '{{"rule_groups":[' || string_agg(case when d is null or depth > d then '' else repeat(']}}', (d - depth + 1)::bigint) || ',' end || head, '' order by path)
       || repeat(']}}', (arg_max(depth, path) + 1)::bigint) || ']}}' as tree
from p group by notice""")
def nested_trees(spark: SparkSession, d: str) -> DataFrame:
    return T.nested_trees(*heap(spark, d))


def opened(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The heaps once nested, opened again; orders of every seventh customer have an operator that does not exist."""
    nested = T.nested_trees(*heap(spark, d)).withColumn("tree", F.when(F.col("notice") % 7 == 0, F.replace("tree", F.lit('"OR"'), F.lit('"NOR"'))).otherwise(F.col("tree")))
    names = spark.createDataFrame([("cgpa",), ("STATE",)], "attribute_name string")
    return T.open_trees(nested, "notice", "tree", names)


_OPENED = f"""
{_HEAP}, {_WALK},
bad as (select distinct notice from g where notice % 7 = 0 and logical_operator = 'OR'),
ids as (select notice, group_id, row_number() over (order by notice, path) as id from w where notice not in (select notice from bad))"""


@query(f"""
with recursive {_OPENED}
select g.notice, i.id as group_id, p.id as parent_group_id, (row_number() over (partition by g.notice, g.parent_group_id order by g.group_number))::int as group_number, g.logical_operator
from g join ids i on i.group_id = g.group_id left join ids p on p.group_id = g.parent_group_id""")
def saved_groups(spark: SparkSession, d: str) -> DataFrame:
    return opened(spark, d)[0]


@query(f"""
with recursive {_OPENED}
select row_number() over (order by i.id, r.rule_id) as rule_id, i.id as group_id, attribute, operator, value from r join ids i on i.group_id = r.group_id""")
def saved_rules(spark: SparkSession, d: str) -> DataFrame:
    return opened(spark, d)[1]


@query(f"with recursive {_OPENED} select notice, 'unsupported operator: NOR' as issue from bad")
def refused_trees(spark: SparkSession, d: str) -> DataFrame:
    return opened(spark, d)[2]


# ---------------------------------------------------------------- two levels, two versions


def two_levels(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An AND group for each return flag of an order, below it an OR group for each line status, its lines as rules."""
    top = lambda x: F.col("l_orderkey") * 1000 + F.ascii(x("l_returnflag"))
    low = lambda x: top(x) + F.ascii(x("l_linestatus")) * 1000000000000

    def group(ident: Column, parent: Column, number: Column, operator: str) -> Column:
        return F.struct(ident.alias("group_id"), parent.alias("parent_group_id"), F.ascii(number).alias("group_number"), F.lit(operator).alias("logical_operator"))

    roots = F.transform("lines", lambda x: group(top(x.getItem), F.lit(None).cast("long"), x["l_returnflag"], "AND"))
    kids = F.transform("lines", lambda x: group(low(x.getItem), top(x.getItem), x["l_linestatus"], "OR"))
    groups = found.select(F.col("l_orderkey").alias("notice"), F.inline(F.array_distinct(F.concat(roots, kids))))
    odd = F.col("l_linenumber") % 2 == 1
    rules = found.select("l_orderkey", F.inline("lines")).select(
        (F.col("l_orderkey") * 100 + F.col("n")).alias("rule_id"), low(F.col).alias("group_id"), F.when(odd, "CGPA").otherwise("State").alias("attribute"),
        F.when(odd, ">=").otherwise("=").alias("operator"), F.col("l_quantity").cast("int").cast("string").alias("value"),
    )
    return groups, rules


def _levels(v: str, lines: str) -> str:
    """CTEs of one version: its rules, lower groups with identity and text, upper groups likewise."""
    return f"""
{v}_rules as (
select l_orderkey as notice, l_returnflag as flag, l_linestatus as status, l_orderkey * 100 + n as rule_id, case when l_linenumber % 2 = 1 then 'CGPA' else 'State' end as attribute,
       case when l_linenumber % 2 = 1 then '>=' else '=' end as operator, l_quantity::int::varchar as value
from ({lines})),
{v}_low as (
select notice, flag, status, '["OR",[' || string_agg('["' || attribute || '","' || operator || '"]', ',' order by attribute, operator) || '],[]]' as identity,
       '{{"logical_operator":"OR","rules":[' || string_agg('{{"attribute":"' || attribute || '","operator":"' || operator || '","value":"' || value || '"}}', ',' order by rule_id)
       || '],"child_groups":[]}}' as tree
from {v}_rules group by all),
{v}_top as (
select notice, flag, '["AND",[],[' || string_agg(identity, ',' order by identity) || ']]' as identity,
       '{{"logical_operator":"AND","rules":[],"child_groups":[' || string_agg(tree, ',' order by status) || ']}}' as tree
from {v}_low group by notice, flag)"""


_NUMBERED = f"select *, row_number() over (partition by l_orderkey order by {', '.join(_ORDER)})::int as n from lineitem"


@query(f"""
with {_levels("a", _NUMBERED)},
every as (
select notice, identity, notice * 1000 + ascii(flag) as group_id from a_top
union all select notice, identity, notice * 1000 + ascii(flag) + ascii(status) * 1000000000000 from a_low)
select group_id, min(group_id) over (partition by notice, identity) as first_group_id, count(*) over (partition by notice, identity) as n from every""")
def same_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each group with the first group of its order that is the same by operator, rules and children, wherever both stand."""
    found = T.described(*two_levels(orders(spark, d)))
    same = Window.partitionBy("notice", "identity")
    return found.select("group_id", F.min("group_id").over(same).alias("first_group_id"), F.count("*").over(same).alias("n"))


def _aligned(name: str, by: str, same: str, order: str, carry: str, a: str, b: str) -> str:
    """CTEs that pair the rows of two versions by `same` and occurrence, with change and index."""
    keys = f"{by}, {same}, i"
    cast = lambda side: ", ".join(f"{side}.{c} as {side}_{c}" for c in carry.split(", "))
    rank = f"row_number() over (partition by {by}, {same} order by {order}) as i"
    return f"""
{name}_a as (select *, {rank} from ({a})), {name}_b as (select *, {rank} from ({b})),
{name}_both as (
select {", ".join(f"coalesce(a.{k}, b.{k}) as {k}" for k in keys.split(", "))}, case when a.notice is null then 'ADDED' when b.notice is null then 'REMOVED' end as change, {cast("a")}, {cast("b")}
from {name}_a a full join {name}_b b on {" and ".join(f"a.{k} = b.{k}" for k in keys.split(", "))}),
{name} as (select *, row_number() over (partition by {by} order by {same}, coalesce(change, ''), i) - 1 as place from {name}_both)"""


@query(f"""
with {_levels("a", f"select * from ({_NUMBERED}) where l_linenumber <> 3")},
{_levels("b", f"select * replace (case when l_linenumber = 2 then l_quantity + 1 else l_quantity end as l_quantity) from ({_NUMBERED}) where l_linenumber <> 1")},
{_aligned("roots", "notice", "identity", "flag", "flag, tree", "select * from a_top", "select * from b_top")},
{_aligned("kids", "notice, prefix", "identity", "status", "flag, status",
          "select k.*, r.place as prefix from a_low k join roots r on r.notice = k.notice and r.a_flag = k.flag where r.change is null",
          "select k.*, r.place as prefix from b_low k join roots r on r.notice = k.notice and r.b_flag = k.flag where r.change is null")},
{_aligned("leaves", "notice, prefix", "attribute, operator", "rule_id", "value",
          "select x.*, k.prefix || '].child_groups[' || k.place as prefix from a_rules x join kids k on k.notice = x.notice and k.a_flag = x.flag and k.a_status = x.status",
          "select x.*, k.prefix || '].child_groups[' || k.place as prefix from b_rules x join kids k on k.notice = x.notice and k.b_flag = x.flag and k.b_status = x.status")}
select notice, 'eligibility_rules.rule_groups[' || place || ']' as path, change as change_type, a_tree as old, b_tree as new from roots where change is not null
union all
select notice, 'eligibility_rules.rule_groups[' || prefix || '].rules[' || place || '].value', 'MODIFIED', a_value, b_value from leaves where a_value <> b_value""")
def group_changes(spark: SparkSession, d: str) -> DataFrame:
    """Orders' trees without their third lines, against those without their first lines and with one more of the second."""
    found = orders(spark, d)
    more = lambda x: F.when(x["l_linenumber"] == 2, x["l_quantity"] + 1).otherwise(x["l_quantity"])
    old = found.withColumn("lines", F.filter("lines", lambda x: x["l_linenumber"] != 3))
    new = found.withColumn("lines", F.transform(F.filter("lines", lambda x: x["l_linenumber"] != 1), lambda x: x.withField("l_quantity", more(x))))
    return T.group_changes(*two_levels(old), *two_levels(new))
