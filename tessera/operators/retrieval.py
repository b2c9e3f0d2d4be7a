"""Passage retrieval: BM25 over a document's passages, facet bonuses, greedy packs under a token budget, quote grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import find_dates, let
from ..functions.numbers import bm25, estimated_tokens
from ..functions.text import grounding, pieces, tokens, word_list
from ..sources.tables import materialise
from .documents import is_contents_page


def bm25_scores(passages: DataFrame, doc: str, ident: str, text: str, terms: dict[str, float], section: str | None = None) -> DataFrame:
    """(doc, ident, score) of every passage that has a term; statistics are those of the passage's document. A section
    title's tokens count twice. Each text is read once: its length and its terms' counts go into a narrow written table, from
    which statistics and scores follow without the text."""
    all_tokens = tokens(F.col(text))
    if section:
        title = tokens(F.coalesce(F.col(section), F.lit("")))
        all_tokens = F.concat(all_tokens, title, title)

    def counted(t: Column) -> Column:
        return F.struct(F.size(t).alias("len"), F.filter(t, lambda x: x.isin(*terms)).alias("hits"))

    def per_term(hits: Column) -> Column:
        each = F.array(*[F.struct(F.lit(term).alias("term"), F.size(F.filter(hits, lambda x: x == F.lit(term))).cast("long").alias("tf")) for term in terms])
        return F.filter(each, lambda c: c["tf"] > 0)

    rows = passages.select(doc, ident, let(all_tokens, counted).alias("c"))
    rows = materialise(rows.select(doc, ident, F.col("c.len").alias("len"), per_term(F.col("c.hits")).alias("counts")), "term-counts")
    stats = rows.groupBy(doc).agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    counts = rows.select(doc, ident, "len", F.inline("counts"))
    df = counts.groupBy(doc, "term").agg(F.count("*").alias("df"))
    weight = F.create_map(*[F.lit(x) for kv in terms.items() for x in kv])[F.col("term")]
    joined = counts.join(df.join(stats, doc), [doc, "term"])
    part = weight * bm25(F.col("tf"), F.col("len"), F.when(F.col("avg") > 0, F.col("avg")).otherwise(1.0), F.col("n"), F.col("df"))
    return joined.groupBy(doc, ident).agg(F.sum(part).alias("score"))


def facet_scores(passages: DataFrame, doc: str, ident: str, text: str, terms: dict[str, float], patterns: dict[str, float], title: str, title_terms: list[str], negative: str, dated: bool = False, page: str | None = None) -> DataFrame:
    """BM25 scaled to 10 in its document, plus weights of patterns and 3 for a title word; a negative title takes 0.4 of it all.
    dated: 0.7 for each of up to six dates, and 0.4 of the scaled part without any. page: 4 less the page on pages 1 to 3."""
    raw = passages.join(bm25_scores(passages, doc, ident, text, terms, title), [doc, ident], "left").fillna(0.0, ["score"])
    top = F.max("score").over(Window.partitionBy(doc))
    score = F.when(top > 0, F.col("score") / top * 10).otherwise(0.0)
    if dated:
        dates = F.size(find_dates(F.col(text)))
        score = score * F.when(dates == 0, 0.4).otherwise(1.0) + F.least(dates, F.lit(6)) * 0.7
    if page:
        score = score + F.when(F.col(page) <= 3, 4 - F.col(page)).otherwise(0)
    for pattern, weight in patterns.items():
        score = score + F.when(F.col(text).rlike(pattern), weight).otherwise(0.0)
    hit = F.lit(False)
    for t in title_terms:
        hit = hit | F.lower(title).contains(t)
    score = score + F.when(F.coalesce(hit, F.lit(False)), 3.0).otherwise(0.0)
    return raw.withColumn("score", score * F.when(F.coalesce(F.col(title).rlike(negative), F.lit(False)), 0.4).otherwise(1.0))


def neighbours(rows: DataFrame, doc: str, width: int = 4096) -> DataFrame:
    """rows (doc, i) with before and after: the i of the rows next to it in its document, null at its ends. In two levels, so
    that a window holds a range of a document's rows, or the first and last of each range."""
    ranged = rows.withColumn("_range", F.floor(F.col("i") / width))
    inside = Window.partitionBy(doc, "_range").orderBy("i")
    ends = ranged.groupBy(doc, "_range").agg(F.min("i").alias("_first"), F.max("i").alias("_last"))
    across = Window.partitionBy(doc).orderBy("_range")
    ends = ends.select(doc, "_range", F.lag("_last").over(across).alias("_prev"), F.lead("_first").over(across).alias("_next"))
    found = ranged.withColumns({"before": F.lag("i").over(inside), "after": F.lead("i").over(inside)}).join(ends, [doc, "_range"])
    return found.withColumns({"before": F.coalesce("before", "_prev"), "after": F.coalesce("after", "_next")}).drop("_range", "_prev", "_next")


def pack(scored: DataFrame, doc: str, ident: str, section: str, text: str, budget: int, least: float = 0.25) -> DataFrame:
    """(doc, ident, tokens): the passages of each document that a budget buys: best first, those that don't fit skipped,
    nothing under a quarter of the best score; then their neighbours in the same section that have a score, in the order of
    the chosen ones. Of equal scores the first passage.

    Of the passages that cost the same only a document's best few can be bought, as many as the budget has room for: one that
    does not fit leaves no room for the next. So the greedy fold sees a list bounded by the budget, whatever the document."""
    cost = (estimated_tokens(F.col(text)) + 4).alias("cost")
    rows = materialise(scored.select(doc, F.col(ident).cast("long").alias("i"), F.coalesce(section, F.lit("")).alias("s"), "score", cost), "scored")
    top = rows.groupBy(doc).agg(F.max("score").alias("top")).where("top > 0")
    rank = F.row_number().over(Window.partitionBy(doc, "cost").orderBy(F.desc("score"), "i"))
    good = rows.join(top, doc).where((F.col("score") >= F.col("top") * least) & (F.col("cost") <= budget)).withColumn("n", rank)
    good = good.where(F.col("n") <= budget // 5).where(F.col("n") * F.col("cost") <= budget)  # a passage costs 5 at least
    kind = "struct<used:bigint,taken:array<bigint>>"

    def buy(state: Column, p: Column) -> Column:
        fits = (state["used"] + p["cost"] <= budget) & ~F.array_contains(state["taken"], p["i"])
        return F.when(fits, F.struct((state["used"] + p["cost"]).alias("used"), F.array_append(state["taken"], p["i"]).alias("taken")).cast(kind)).otherwise(state)

    none = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("taken")).cast(kind)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "i", "cost")))
    bought = materialise(good.groupBy(doc).agg(listed.alias("list")).select(doc, F.aggregate("list", none, buy).alias("state")), "bought")

    chosen = bought.select(doc, F.posexplode("state.taken").alias("k", "i"))
    beside = chosen.join(neighbours(rows.select(doc, "i", "s"), doc), [doc, "i"])
    asked = beside.select(doc, F.col("s").alias("_s"), F.inline(F.array(*[F.struct((F.col("k") * 2 + side).alias("o"), F.col(c).alias("i")) for side, c in enumerate(("before", "after"))])))
    near = asked.join(rows, [doc, "i"]).where("s = _s and score > 0").groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("o", "i", "cost"))).alias("list"))
    whole = bought.join(near, doc, "left").select(doc, F.explode(F.when(F.col("list").isNull(), F.col("state.taken")).otherwise(F.aggregate("list", F.col("state"), buy)["taken"])).alias("i"))
    return whole.join(rows, [doc, "i"]).select(doc, F.col("i").alias(ident), F.col("cost").alias("tokens"))


def locate_quotes(quotes: DataFrame, passages: DataFrame, quote_id: str, quote: str, doc: str, passage: str, text: str, cited: str | None = None) -> DataFrame:
    """Where each quote stands in each document of its own: (quote_id, doc, passage, exact, ratio), the best passage.

    A quote of at least 4 normal characters is there exactly, or with 3 words or more when 85 % of its distinct words are.
    Of equally good passages the cited one (a column of quotes) comes first, then the first in order. quotes and passages
    share the column doc: a quote is only looked for in the passages of its own document."""
    said = F.col(cited) if cited else F.lit(None).cast("long")
    q = quotes.select(doc, quote_id, said.alias("_cited"), grounding(F.col(quote)).alias("_q")).where(F.length("_q") >= 4).withColumn("_qw", F.array_distinct(word_list(F.col("_q"))))
    # A passage's words are listed once, before it meets its quotes.
    p = passages.select(doc, passage, grounding(F.col(text)).alias("_p")).withColumn("_pw", F.array_distinct(word_list(F.col("_p"))))
    exact = F.col("_p").contains(F.col("_q"))
    ratio = F.size(F.array_intersect("_qw", "_pw")) / F.size("_qw")
    both = q.join(p, doc).withColumn("exact", exact).withColumn("ratio", ratio)
    found = both.where("exact or (size(_qw) >= 3 and ratio >= 0.85)")
    ranked = F.struct("exact", F.when(F.col("exact"), 1.0).otherwise(F.col("ratio")), F.col("_cited").eqNullSafe(F.col(passage)), -F.col(passage))
    best = F.max_by(F.struct(passage, "exact", "ratio"), ranked)
    return found.groupBy(doc, quote_id).agg(best.alias("b")).select(doc, quote_id, "b.*")


def quote_candidates(quotes: DataFrame, docs: DataFrame, quote_id: str, quote: str, doc: str, text: str) -> DataFrame:
    """(doc, quote_id, quote) of every pair that locate_quotes may find, so that each quote is looked for in all documents.

    A quote that is found lacks at most 15 % of its distinct words, or its first and last one where it begins and ends within
    words: of one more of its words than that, the rarest ones, the document has one. Quotes of fewer than three distinct
    words are only found exactly, so they meet the documents that have the rarest of their pieces of three characters."""
    q = quotes.select(quote_id, quote, grounding(F.col(quote)).alias("_q")).where(F.length("_q") >= 4).withColumn("_w", F.array_distinct(word_list(F.col("_q"))))
    own = q.where("size(_w) >= 3").select(quote_id, F.explode("_w").alias("_word"), F.greatest(F.lit(2), F.floor(F.size("_w") * 0.15 + 1e-9)).alias("_lack"))
    held = docs.select(doc, F.explode(F.array_distinct(word_list(grounding(F.col(text))))).alias("_word"))
    held = held.join(own.select("_word").distinct(), "_word", "left_semi")
    often = held.groupBy("_word").agg(F.count("*").alias("_df"))
    rank = F.row_number().over(Window.partitionBy(quote_id).orderBy(F.coalesce("_df", F.lit(0)), "_word"))
    rare = own.join(often, "_word", "left").withColumn("_rank", rank).where("_rank <= _lack + 1").select(quote_id, "_word")
    found = rare.join(held, "_word").select(doc, quote_id).distinct().join(q.select(quote_id, quote), quote_id)
    short = q.where("size(_w) < 3").select(quote_id, quote, F.explode(pieces(F.col("_q"), F.lit(3))).alias("_piece"))
    if short.isEmpty():
        return found.select(doc, quote_id, quote)
    parts = docs.select(doc, F.explode(pieces(grounding(F.col(text)), F.lit(3))).alias("_piece")).join(short.select("_piece").distinct(), "_piece", "left_semi")
    common = parts.groupBy("_piece").agg(F.count("*").alias("_df"))
    chosen = short.join(common, "_piece", "left").groupBy(quote_id, quote).agg(F.min_by("_piece", F.struct(F.coalesce("_df", F.lit(0)), "_piece")).alias("_piece"))
    return found.select(doc, quote_id, quote).unionByName(chosen.join(parts, "_piece").select(doc, quote_id, quote))


HEADING_LEVELS = 4
# A heading marked by up to four #, a numbered heading of plain text, the marks around a table.
MARKED_HEADING = r"^(#{1,4}) (.+)$"
PLAIN_HEADING = r"^\d+(?:\.\d+){0,2}[.)]?\s+[A-Z][^.]{2,90}$"
TABLE_OPENS, TABLE_CLOSES = "[TABLE]", "[/TABLE]"


def section_passages(pages: DataFrame, doc: str, page: str, text: str, size: int = 1400, plain: bool = False) -> DataFrame:
    """(doc, passage, page, section, is_table, text): lines gathered up to size characters, never across a page, a heading or
    a table's border; a table up to twice the size, its first line repeated in each part. section is the path of headings
    above: a heading ends all of its own and deeper levels. Pages that are a table of contents are left out.

    Windows over a document's lines give path and segment; only inside a segment, a part of one page, a fold packs lines."""
    shown = pages.where((F.trim(text) != "") & ~is_contents_page(F.col(text)))
    lines = shown.select(doc, page, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line", F.rtrim("line")).where("trim(line) <> ''")
    opens, closes = F.col("line") == TABLE_OPENS, F.col("line") == TABLE_CLOSES
    here = Window.partitionBy(doc, page).orderBy("line_no")
    lines = lines.withColumn("is_table", F.coalesce(F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(here), F.lit(False)))
    marks = F.length(F.regexp_extract("line", MARKED_HEADING, 1))
    level = F.when(F.col("is_table") | opens | closes, 0).when(marks > 0, marks)
    if plain:
        level = level.when(F.col("line").rlike(PLAIN_HEADING), 2)
    lines = lines.withColumn("level", level.otherwise(0))
    title = F.trim(F.when(marks > 0, F.regexp_extract("line", MARKED_HEADING, 2)).otherwise(F.col("line")))
    upto = Window.partitionBy(doc).orderBy(page, "line_no").rowsBetween(Window.unboundedPreceding, 0)
    for k in range(1, HEADING_LEVELS + 1):
        lines = lines.withColumn(f"h{k}", F.max(F.when(F.col("level") == k, F.struct(F.struct(page, "line_no").alias("at"), title.alias("title")))).over(upto))
    path = []
    for k in range(1, HEADING_LEVELS + 1):
        live = F.lit(True)
        for j in range(1, k):
            live = live & F.coalesce(F.col(f"h{k}.at") > F.col(f"h{j}.at"), F.lit(True))
        path.append(F.when(live, F.col(f"h{k}.title")))
    joined = F.left(F.concat_ws(" > ", *path), F.lit(160))
    borders = (F.col("level") > 0) | opens | closes
    lines = lines.withColumns({"section": F.when(joined == "", "Document").otherwise(joined), "segment": F.sum(borders.cast("int")).over(upto)})
    held = lines.where(~borders).groupBy(doc, page, "segment", "section", "is_table").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("lines"))

    limit = F.when(F.col("is_table"), 2 * size).otherwise(size)
    kind = "struct<now:array<string>,length:int,done:array<array<string>>>"

    def step(acc: Column, line: Column) -> Column:
        full = (acc["length"] + F.length(line) > limit) & (F.size(acc["now"]) > 0)
        header = F.when(F.col("is_table"), F.slice(acc["now"], 1, 1)).otherwise(F.array().cast("array<string>"))
        kept = F.when(full, header).otherwise(acc["now"])
        length = F.when(full, F.aggregate(header, F.lit(0), lambda n, x: n + F.length(x) + 1)).otherwise(acc["length"])
        done = F.when(full, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"])
        return F.struct(F.array_append(kept, line).alias("now"), (length + F.length(line) + 1).alias("length"), done.alias("done")).cast(kind)

    empty = F.struct(F.array().cast("array<string>").alias("now"), F.lit(0).alias("length"), F.array().cast("array<array<string>>").alias("done")).cast(kind)
    parts = F.aggregate("lines", empty, step, lambda acc: F.array_append(acc["done"], acc["now"]))
    rows = held.select(doc, page, "segment", "section", "is_table", F.posexplode(parts).alias("part", "own"))
    number = F.row_number().over(Window.partitionBy(doc).orderBy(page, "segment", "part")) - 1
    return rows.select(doc, number.cast("long").alias("passage"), page, "section", "is_table", F.trim(F.array_join("own", "\n")).alias("text"))


# What a reviewer's feedback says of each facet, and words of it that are no search terms.
FEEDBACK_HINTS = {
    "identity": ("name", "body", "organi", "conduct", "authority", "release"),
    "dates": ("date", "deadline", "last", "start", "end", "open", "close", "schedule"),
    "eligibility": (
        "eligib", "age", "qualif", "nationality", "degree", "experience",
        "marks", "percentage", "cgpa", "rule",
    ),
}
FEEDBACK_STOP = (
    "the", "and", "for", "with", "that", "this", "from", "are", "was",
    "were", "not", "but", "has", "have", "been", "should", "please",
    "incorrect", "wrong", "check", "again", "document",
)


def feedback_facets(feedback: Column) -> Column:
    """The facets that a reviewer's feedback is about."""
    said = F.lower(F.coalesce(feedback, F.lit("")))
    hits = []
    for name, hints in FEEDBACK_HINTS.items():
        any_ = F.lit(False)
        for h in hints:
            any_ = any_ | said.contains(h)
        hits.append(F.when(any_, name))
    return F.array_compact(F.array(*hits))


def feedback_terms(feedback: Column, weight: float = 2.0) -> Column:
    """(term, weight) of the words of feedback that are worth a search: three letters or more and no stop words."""
    words = F.array_distinct(F.filter(tokens(F.coalesce(feedback, F.lit(""))), lambda t: (F.length(t) > 2) & ~t.isin(*FEEDBACK_STOP)))
    return F.transform(words, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight")))


def context_budget(request: Column, overhead: Column, answer: Column) -> Column:
    """Tokens left for passages in a request: without prompt, answer and a reserve of 250, at least 800."""
    return F.greatest(F.lit(800), request - overhead - answer - 250)
