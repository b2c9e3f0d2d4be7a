"""Document analytics: chunks, sections, headings, gates, links, merged extractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import addresses as W
from ..functions.dates import let
from ..functions.text import host, same_site


def chunks(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, chunk_no, chunk): a text in pieces of size characters, nothing lost; an empty text gives none."""
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.length(text) / size).cast("int") - 1), lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)))
    return docs.where(F.length(text) > 0).select(key, F.posexplode(parts).alias("chunk_no", "chunk"))


def page_chunks(pages: DataFrame, doc: str, page: str, text: str, size: int) -> DataFrame:
    """Pages of a document run together and cut every size characters: (doc, chunk_no, chunk, first_page, last_page)."""
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = pages.where(F.length(text) > 0).withColumn("_at", before)
    first, last = F.floor(F.col("_at") / size), F.floor((F.col("_at") + F.length(text) - 1) / size)
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("chunk_no") * size - F.col("_at"), F.lit(0))
    stop = F.least((F.col("chunk_no") + 1) * size - F.col("_at"), F.length(text))
    rows = rows.withColumn("_part", F.substring(F.col(text), (start + 1).cast("int"), (stop - start).cast("int")))
    parts = F.array_sort(F.collect_list(F.struct(page, "_part")))
    return rows.groupBy(doc, "chunk_no").agg(F.array_join(F.transform(parts, lambda s: s["_part"]), "").alias("chunk"), F.min(page).alias("first_page"), F.max(page).alias("last_page"))


def packed_paragraphs(text: Column, size: int) -> Column:
    """Paragraphs (by line) packed greedily into chunks of at most size characters, never split."""

    def step(acc: Column, p: Column) -> Column:
        joined = F.concat(acc["now"], F.lit("\n"), p)
        fits = F.length(joined) <= size
        return F.when(acc["now"] == "", F.struct(p.alias("now"), acc["done"].alias("done"))).when(fits, F.struct(joined.alias("now"), acc["done"].alias("done"))).otherwise(F.struct(p.alias("now"), F.array_append(acc["done"], acc["now"]).alias("done")))

    lines = F.filter(F.transform(F.split(text, "\n"), lambda p: F.trim(p)), lambda p: p != "")
    empty = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))
    return F.aggregate(lines, empty, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.array_append(a["done"], a["now"])))


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def from_keyword_on(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, line_no, line): lines from the first one that matches; the latch never closes. Inside the text's own row."""

    def kept(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), F.lit(True))
        rest = F.slice(lines, F.greatest(first, F.lit(1)), F.size(lines))
        numbered = F.transform(rest, lambda x, i: F.struct((first - 1 + i).cast("int").alias("line_no"), x.alias("line")))
        return F.when(first > 0, numbered)

    return docs.select(key, F.inline(let(F.split(text, "\n"), kept)))


def sections(docs: DataFrame, key: str, text: str, heading: Callable[[Column], Column]) -> DataFrame:
    """(key, section_no, title, content): heading lines and the content below each; lines before the first are section 0.
    Inside the text's own row: no line is shuffled."""

    def cut(lines: Column) -> Column:
        heads = F.array_compact(F.transform(lines, lambda x, i: F.when(heading(x), i)))
        starts = F.when(F.coalesce(F.get(heads, F.lit(0)) == 0, F.lit(False)), heads).otherwise(F.concat(F.array(F.lit(-1)), heads))

        def parts(at: Column) -> Column:
            def one(s: Column, k: Column) -> Column:
                end = F.coalesce(F.get(at, k + 1), F.size(lines))
                number = F.when(F.get(at, F.lit(0)) < 0, k).otherwise(k + 1)
                content = F.array_join(F.slice(lines, s + 2, end - s - 1), "\n")
                return F.struct(number.cast("long").alias("section_no"), F.when(s >= 0, F.get(lines, s)).alias("title"), content.alias("content"))

            return F.transform(at, one)

        return let(starts, parts)

    return docs.where(F.col(text).isNotNull()).select(key, F.inline(let(F.split(text, "\n"), cut)))


def section_spans(headings: DataFrame, key: str, page: str, last_page: Column) -> DataFrame:
    """Every heading's section ends on the page before the next heading's, or on the document's last page."""
    w = Window.partitionBy(key).orderBy(page)
    return headings.withColumn("end_page", F.greatest(F.col(page), F.coalesce(F.lead(page).over(w) - 1, last_page)))


def weighted_score(title: Column, content: Column, title_terms: dict[str, float], content_terms: dict[str, float], negative: dict[str, float]) -> Column:
    """Weights of the terms found, held to -10..15 and rounded to two places."""
    total = F.lit(0.0)
    for terms, where in ((title_terms, title), (content_terms, content), (negative, title)):
        for pattern, weight in terms.items():
            total = total + F.when(F.coalesce(where.rlike(pattern), F.lit(False)), weight).otherwise(0.0)
    return F.round(F.greatest(F.lit(-10.0), F.least(total, F.lit(15.0))), 2)


def is_contents_page(text: Column) -> Column:
    """A table of contents: five lines or more, and two fifths of all, end in leaders and a page number."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    hits = F.size(F.filter(lines, lambda x: x.rlike(r"\.{3,}\s*\d+\s*$")))
    return (hits >= 5) & (hits >= 0.4 * F.size(lines))


def repeated_margins(lines: DataFrame, doc: str, page: str, key: Column) -> DataFrame:
    """Margin keys on at least 3 pages and a quarter of a document's pages; none for documents under 4 pages."""
    pages = lines.groupBy(doc).agg(F.countDistinct(page).alias("_pages")).where("_pages >= 4")
    counts = lines.select(doc, page, key.alias("margin")).where("margin <> ''").groupBy(doc, "margin").agg(F.countDistinct(page).alias("on_pages"))
    return counts.join(pages, doc).where(F.col("on_pages") >= F.greatest(F.lit(3), F.floor(F.col("_pages") * 0.25))).select(doc, "margin", "on_pages")


def body_size(spans: DataFrame, doc: str, size: str, chars: str) -> DataFrame:
    """The font size most characters of a document have; the smaller of equals."""
    sums = spans.groupBy(doc, size).agg(F.sum(chars).alias("_n"))
    return sums.groupBy(doc).agg(F.max_by(size, F.struct("_n", -F.col(size))).alias("body_size"))


def gate(text: Column, wording: list[str], rejects: list[tuple[str, str]], year: Column | None = None) -> Column:
    """(ok, reason) of a document: long enough or unreadable, no rejected kind in its heading, eligibility wording, the right year."""
    head = F.lower(F.left(text, F.lit(400)))
    hits = F.lit(0)
    for w in wording:
        hits = hits + F.when(F.lower(text).contains(w), 1).otherwise(0)
    case = F.when(F.length(F.trim(text)) == 0, F.struct(F.lit(True).alias("ok"), F.lit("no text").alias("reason")))
    case = case.when(F.length(text) < 300, F.struct(F.lit(False).alias("ok"), F.lit("too short").alias("reason")))
    for pattern, reason in rejects:
        case = case.when(head.rlike(pattern), F.struct(F.lit(False).alias("ok"), F.lit(reason).alias("reason")))
    case = case.when(hits < 2, F.struct(F.lit(False).alias("ok"), F.lit("no eligibility wording").alias("reason")))
    if year is not None:
        seen = F.array_distinct(F.regexp_extract_all(F.left(text, F.lit(6000)), F.lit(r"(?<!\d)(20\d{2})(?!\d)"), 1))
        wrong = year.isNotNull() & (F.size(seen) > 0) & ~F.array_contains(seen, year)
        case = case.when(wrong, F.struct(F.lit(False).alias("ok"), F.concat(F.lit("year "), F.array_join(seen, ","), F.lit(" instead of "), year).alias("reason")))
    return case.otherwise(F.struct(F.lit(True).alias("ok"), F.lit("ok").alias("reason")))


def links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, link, ord, label): a page's anchors as absolute https addresses, the first of equal ones, numbered in page order;
    without scripts (javascript:) and fragments of the page itself (#). label is the anchor's text, its parts run together.
    Character references are resolved, quotes around a value are not needed, other schemes than https give no link."""
    rows = pages.select(key, F.col(url).alias("base"), F.posexplode(W.anchors(F.col(html))).alias("ord", "anchor"))
    rows = rows.select(key, "base", "ord", W.attribute(W.opening(F.col("anchor")), "href").alias("href"), W.texts(F.col("anchor")).alias("texts"))
    rows = rows.withColumn("plain", W.unescaped(F.array_prepend("texts", F.col("href"))))
    rows = rows.withColumn("href", F.get("plain", F.lit(0))).where("href <> '' and not startswith(href, 'javascript:') and not startswith(href, '#')")
    label = W.run_together(F.slice("plain", F.lit(2), F.size("plain")))
    rows = rows.select(key, "ord", W.resolved(F.col("base"), F.col("href")).alias("link"), label.alias("label")).where("startswith(link, 'https')")
    return rows.groupBy(key, "link").agg(F.min("ord").cast("long").alias("ord"), F.min_by("label", "ord").alias("label"))


def reachable(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes within depth steps of the seeds, at their least depth; a breadth-first crawl over an edge table."""
    found = seeds.select("node", F.lit(0).alias("depth")).distinct()
    front = found
    for k in range(1, depth + 1):
        near = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = near.join(found, "node", "left_anti").select("node", F.lit(k).alias("depth"))
        found = found.unionByName(front)
    return found


def merged_scalar(values: DataFrame, key: str, value: str) -> DataFrame:
    """One value out of several chunks': null ones ignored, several different ones are a conflict."""
    return values.groupBy(key).agg(F.min(value).alias("merged"), (F.countDistinct(value) > 1).alias("conflict"))


def first_seen(values: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The distinct values of a key in the order in which they first came."""
    firsts = values.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("_o"))
    return firsts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda s: s[value]).alias("merged"))


def history_tail(turns: DataFrame, key: str, turn: str, last: int, width: int, roles: list[str]) -> DataFrame:
    """The last turns of a conversation, of these the ones with a known role, cut to width characters."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(turn)))
    kept = turns.withColumn("_r", rank).where(F.col("_r") <= last).where(F.col("role").isin(*roles))
    return kept.drop("_r").withColumn("text", F.left("text", F.lit(width)))


def heading_kind(line: Column) -> Column:
    """How a line shows that it is a heading: a number before it, or capitals throughout."""
    numbered = line.rlike(r"^\s*[0-9]+[.)]")
    return F.when(numbered, "numbered").when((F.upper(line) == line) & line.rlike("[A-Za-z]"), "uppercase").otherwise("none")


def is_code_like(line: Column) -> Column:
    """A short code such as B1.2 or XH5.11:"""
    return F.trim(line).rlike(r"(?i)^[a-z]{1,4}[0-9]+([.][0-9]+)*[:.]?$")


def is_noise(line: Column, exact: list[str]) -> Column:
    """No heading whatever its shape: nothing, no letter, a code, a bare `Section 2`, or one of the exact texts."""
    bare = F.upper(F.trim(line))
    label = bare.rlike(r"^(SECTION|CHAPTER|PART)\s+[A-Z0-9]+([.][0-9]+)*$")
    return F.coalesce((bare == "") | ~bare.rlike("[A-Z]") | is_code_like(line) | label | bare.isin(*exact), F.lit(True))


def heading_confidence(line: Column, explicit: Column) -> Column:
    """0 to 1 from a line's shape; explicit: it says section, part or the like."""
    kind, words = heading_kind(line), F.regexp_count(line, F.lit(r"\S+"))
    sentence = (F.length(line) > 120) | ((words >= 8) & line.rlike("[.?!]$"))
    digit_share = F.regexp_count(line, F.lit("[0-9]")) / F.greatest(F.lit(1), F.length(line))
    # The weight of each sign.
    signs = [
        (words >= 2, 0.20),
        (F.length(line).between(8, 100), 0.15),
        (kind == "numbered", 0.30),
        (explicit, 0.25),
        (kind == "uppercase", 0.05),
        (sentence, -0.45),
        (digit_share > 0.30, -0.25),
    ]
    score = sum((F.when(sign, weight).otherwise(0.0) for sign, weight in signs), F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)


def dedupe_headings(rows: DataFrame, doc: str, order: str, title: str, page: Column, within: int, pages: int) -> DataFrame:
    """Headings without those equal to one of the last `within` kept ones at most `pages` pages before. What is kept decides
    what is dropped later, so a fold over each document's headings in order."""
    item = F.struct(F.col(order).alias("o"), F.col(title).alias("t"), page.cast("long").alias("p"))
    one = f"struct<o:{_type(rows, order)},t:string,p:bigint>"

    def step(kept: Column, x: Column) -> Column:
        near = F.slice(F.reverse(kept), 1, within)
        seen = F.exists(near, lambda k: (F.lower(k["t"]) == F.lower(x["t"])) & (F.abs(k["p"] - x["p"]) <= pages))
        return F.when(seen, kept).otherwise(F.array_append(kept, x))

    listed = rows.groupBy(doc).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    kept = F.aggregate("_all", F.array().cast(f"array<{one}>"), step)
    return listed.select(doc, F.explode(kept).alias("_k")).select(doc, F.col("_k.o").alias(order), F.col("_k.t").alias(title))


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def has_wording(text: Column, pattern: str, least: int = 2) -> Column:
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(pattern)) >= least, F.lit(False))


def score_links(found: DataFrame, weights: dict[str, int], rejects: list[str]) -> DataFrame:
    """links with score: the weights of words in address or label; -100 for an address with a rejected word."""
    seen = F.lower(F.concat_ws(" ", "link", "label"))
    score = F.lit(0)
    for word, weight in weights.items():
        score = score + F.when(seen.contains(word), weight).otherwise(0)
    for word in rejects:
        score = score + F.when(F.col("link").contains(word), -100).otherwise(0)
    return found.withColumn("score", score.cast("long"))


def best_links(scored: DataFrame, key: str, most: int) -> DataFrame:
    """The best positive links of each key by score, then address."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.desc("link")))
    return scored.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= most)


def seed_links(pages: DataFrame, key: str, url: str, paths: list[str]) -> DataFrame:
    """Fixed paths on every page's host."""
    root = F.regexp_replace(F.regexp_extract(url, r"^(https?://[^/?#]+)", 1), "^http:", "https:")
    rows = pages.select(key, root.alias("_root"), F.posexplode(F.array(*map(F.lit, paths))).alias("step", "_path"))
    return rows.where("_root <> ''").select(key, "step", F.concat("_root", "_path").alias("link"))


def ordered_issues(severities: Column) -> Column:
    """Distinct severities, errors first."""
    rank = F.transform(F.array_distinct(severities), lambda s: F.struct(F.when(s == "error", 0).when(s == "warning", 1).otherwise(2).alias("r"), s.alias("s")))
    return F.transform(F.array_sort(rank), lambda x: x["s"])


def content_matches(text: Column, identity: list[str], years: list[str], span: int = 6000) -> Column:
    """The text's start names two of the identity's words (one, if it has one) and, if it has years, one of these."""
    head = F.lower(F.left(text, F.lit(span)))
    hits = sum((F.when(head.rlike(rf"(?<![\p{{L}}\p{{N}}_]){w}(?![\p{{L}}\p{{N}}_])"), 1).otherwise(0) for w in identity), F.lit(0))
    seen = F.lit(not years)
    for y in years:
        seen = seen | head.contains(y)
    return F.coalesce((hits >= min(2, len(identity))) & seen, F.lit(False))


# Any of these rejects a link.
LINK_REJECTS = (
    "history", "history of gate", "history_of_gate", "gallery", "annual report", "annual-report", "annual_report", "newsletter",
    "magazine", "tender", "convocation", "sports", "cultural", "syllabus", "answer key", "answerkey", "answer_key",
    "question paper", "questionpaper", "question-paper", "test paper", "testpaper", "test-paper", "sample paper",
    "samplepaper", "sample-paper", "previous year", "old paper",
)
# Each of these adds 1.
LINK_WORDS = ("notification", "advertisement", "notice", "examination", "exam", "recruitment", "application", "brochure", "information", "circular", "download")
# Each of these adds 6.
LINK_STRONG = ("information brochure", "info brochure", "notification", "advertisement", "advt", "brochure")
# Each of these takes 15.
LINK_WEAK = (
    "history", "about us", "about-us", "gallery", "photo gallery", "annual report", "rti", "right to information",
    "press release", "press-release", "newsletter", "magazine", "tender", "profile", "vision and mission", "org chart",
    "organogram", "citizen charter", "grievance", "faq", "media coverage", "achievements", "success stor", "alumni",
    "convocation", "sports", "cultural",
)


def count_of(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    """How many of the words a text contains."""
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)))


def document_link_score(url: Column, label: Column, identity: list[str], years: list[str]) -> Column:
    """How likely a link is the wanted document: 5 for .pdf, the words' weights, 4 for each word of the identity (none:
    rejected), 5 for a wanted year; another year in the address rejects, in the label it takes 8. Rejected is -100."""
    text = F.lower(F.concat(F.coalesce(url, F.lit("")), F.lit(" "), F.coalesce(label, F.lit(""))))

    def scored(seen: Column) -> Column:
        score = F.when(seen.contains(".pdf"), 5).otherwise(0) + count_of(seen, LINK_WORDS) + 6 * count_of(seen, LINK_STRONG) - 15 * count_of(seen, LINK_WEAK)
        reject = count_of(seen, LINK_REJECTS) > 0
        if identity:
            hits = count_of(seen, [t.lower() for t in identity])
            reject, score = reject | (hits == 0), score + hits * 4
        if years:
            found = lambda text: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![0-9])(20[0-9]{2})(?![0-9])"), 1)
            wanted, in_url, in_label = F.array(*map(F.lit, years)), found(F.try_parse_url(url, F.lit("PATH"))), found(label)
            reject = reject | ((F.size(in_url) > 0) & ~F.arrays_overlap(in_url, wanted))
            of_label = F.when(F.size(in_label) == 0, 0).when(F.arrays_overlap(in_label, wanted), 5).otherwise(-8)
            score = score + F.when(F.size(in_url) > 0, 5).otherwise(of_label)
        return F.when(reject, -100).otherwise(score).cast("long")

    return let(text, scored)  # once for all words


def source_score(title: Column, text: Column, host: Column) -> Column:
    """How official a search result looks."""
    t, x, h = (F.lower(F.coalesce(c, F.lit(""))) for c in (title, text, host))
    either = lambda w: t.contains(w) | x.contains(w)
    # The weight of each sign.
    signs = [
        (either("official"), 12),
        (either("notification"), 10),
        (either("information brochure"), 9),
        (either("examination"), 5),
        (t.contains("application") | t.contains("admission"), 3),
        (h.contains(".gov.in") | h.contains(".nic.in"), 8),
        (h.contains(".gov."), 8),
        (h.contains(".ac.in") | h.contains(".edu.in"), 6),
        (h.contains(".ac.") | h.contains(".edu."), 4),
    ]
    return sum((F.when(sign, n).otherwise(0) for sign, n in signs), F.lit(0)).cast("long")


def name_line(text: Column, first: int = 40) -> Column:
    """The line among a text's first ones that is likeliest an exam's name, the earlier of equals; null without a candidate
    (5 to 150 characters)."""
    lines = F.slice(F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, first)

    def judged(line: Column, i: Column) -> Column:
        low = F.lower(line)
        # The weight of each sign.
        score = (
            F.when(low.contains("examination"), 4).when(low.contains("exam"), 3).otherwise(0)
            + F.when(line.rlike(r"\d"), 1).otherwise(0)
            + F.when((F.upper(line) == line) & (low != line), 2).otherwise(0)
            + F.when(i < 10, 2).otherwise(0)
            - F.when(low.rlike("commission|department|university|government"), 2).otherwise(0)
        )
        return F.when(F.length(line).between(5, 150), F.struct(score.alias("score"), (-i).alias("place"), line.alias("line")))

    return F.array_max(F.array_compact(F.transform(lines, judged)))["line"]


# Lines that are no heading, the three forms of a heading, and the confidence that each needs.
NO_HEADING = ["CONTENTS", "TABLE OF CONTENTS", "PAGE", "PAGES", "INDEX", "ANNEXURE", "ANNEXURES", "APPENDIX", "APPENDICES"]
EXPLICIT_HEADING = r"(?i)^\s*(SECTION|CHAPTER|PART)\s+([A-Z0-9IVX]+(?:\.\d+)*)[\s:.\-–—]*(.*)$"
NUMBERED_HEADING = r"^\s*(\d+(?:\.\d+)*)[\.\)]?\s+(.+?)\s*$"
UPPERCASE_HEADING = r"^[A-Z][A-Z0-9&(),:/+\-–—' ]{4,100}$"
EXPLICIT_LEAST, NUMBERED_LEAST, UPPERCASE_LEAST = 0.50, 0.55, 0.60


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def shape_confidence(line: Column, sign: Column | float) -> Column:
    """0 to 1: what a line's words, length, sentence form and digits say, plus the sign of its form."""
    words = word_count(line)
    sentence = (F.length(line) > 120) | ((words >= 8) & line.rlike("[.?!]$"))
    digits = F.regexp_count(line, F.lit(r"\d")) / F.greatest(F.lit(1), F.length(line))
    score = F.when(words >= 2, 0.20).otherwise(0.0) + F.when(F.length(line).between(8, 100), 0.15).otherwise(0.0) + sign
    score = score - F.when(sentence, 0.45).otherwise(0.0) - F.when(digits > 0.30, 0.25).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)


def detected_heading(line: Column) -> Column:
    """(title, level, confidence) of a line that is a heading: explicit (section, chapter, part), numbered up to three
    levels, or in capitals; null for any other, and for one below its form's confidence."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(line), r"\s+", " "), r"(?:\.{2,}|…{2,}|\s{3,})\s*\d+\s*$", ""), r"[.\-–—:]+$", ""))
    noise = is_noise(bare, NO_HEADING) | bare.rlike(r"^\d+\s*[:.)]?$")
    own = F.trim(F.regexp_extract(bare, EXPLICIT_HEADING, 3))
    number, rest = F.regexp_extract(bare, NUMBERED_HEADING, 1), F.trim(F.regexp_extract(bare, NUMBERED_HEADING, 2))
    depth = F.size(F.split(number, r"\."))
    sentence = (F.length(rest) > 120) | ((word_count(rest) >= 8) & rest.rlike("[.?!]$"))
    named = lambda level, c: F.struct(bare.alias("title"), level.cast("int").alias("level"), c.alias("confidence"))
    explicit, numbered, capital = (shape_confidence(bare, x) for x in (0.25, 0.30, 0.05))
    if_explicit = F.when((own != "") & ~is_code_like(own) & (word_count(own) >= 2) & (explicit >= EXPLICIT_LEAST), named(F.lit(1), explicit))
    if_numbered = F.when((depth <= 3) & (word_count(rest) >= 2) & ~sentence & ~is_code_like(rest) & (numbered >= NUMBERED_LEAST), named(depth, numbered))
    if_capital = F.when((word_count(bare) >= 2) & (capital >= UPPERCASE_LEAST), named(F.lit(1), capital))
    form = F.when(bare.rlike(EXPLICIT_HEADING), if_explicit).when(bare.rlike(NUMBERED_HEADING), if_numbered).when(bare.rlike(UPPERCASE_HEADING), if_capital)
    return F.when(~noise, form)


def is_fragment(title: Column, level: Column, confidence: Column) -> Column:
    """A detected heading that is a piece of a form, table or syllabus instead."""
    # What such pieces look like.
    return (
        title.rlike(r"(?i)\b(?:XE|XH|XL)\d+\.\d+\b")
        | title.rlike(r"^[A-Z,\s]+$")
        | title.rlike(r"^(TDS,|BOD,|COD)")
        | title.rlike(r"(?i)^\d+\.\s+(This certificate|I do hereby)")
        | title.rlike(r"(?i)^Part A consists of")
        | ((level == 1) & (confidence < 0.70) & ~title.rlike(r"^\d+(?:\.\d+)*[\.\)]?\s+"))
    )


def search_results(rows: DataFrame, query: str, url: str, title: str, content: str, score: str, order: str) -> DataFrame:
    """Results of several queries as one list: without address dropped, texts trimmed (null: empty), a score that is no
    number null, of equal addresses the first (by query, then order)."""
    clean = rows.where(F.trim(F.coalesce(url, F.lit(""))) != "").select(
        F.trim(url).alias("url"), F.trim(F.coalesce(title, F.lit(""))).alias("title"), F.trim(F.coalesce(content, F.lit(""))).alias("content"),
        F.col(score).try_cast("double").alias("score"), F.struct(query, order).alias("_at"),
    )
    return clean.groupBy("url").agg(F.min_by(F.struct("title", "content", "score"), "_at").alias("r")).select("url", "r.*")


def best_sources(results: DataFrame, own: Column, most: int = 12) -> DataFrame:
    """The results with the best scores of their own, the provider's score (null: 0) deciding among equals, then the address."""
    return results.withColumn("own_score", own).orderBy(F.desc("own_score"), F.desc(F.coalesce("score", F.lit(0.0))), "url").limit(most)


def best_sources_of(results: DataFrame, key: str, own: Column, most: int = 12) -> DataFrame:
    """The same for every key at once, with place."""
    order = Window.partitionBy(key).orderBy(F.desc("own_score"), F.desc(F.coalesce("score", F.lit(0.0))), "url")
    return results.withColumn("own_score", own).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


# What is searched for with a name.
SOURCE_SEARCHES = ("official notification", "official website", "notification PDF", "recruitment notification")


def source_searches(names: DataFrame, key: str, name: Column) -> DataFrame:
    """(key, n, query): the searches for the sources of a name."""
    queries = F.array(*[F.concat_ws(" ", F.trim(name), F.lit(q)) for q in SOURCE_SEARCHES])
    return names.select(key, F.posexplode(queries).alias("n", "query"))


def selected_sections(scored: DataFrame, doc: str, section: str, page: str, score: str, least: float = 2.5, most: int = 20) -> DataFrame:
    """Of each document the relevant sections (column relevant) that score `least`, the first `most` in document order: by page
    (null last), then section."""
    kept = scored.where(F.col("relevant") & (F.col(score) >= least))
    place = F.row_number().over(Window.partitionBy(doc).orderBy(F.col(page).asc_nulls_last(), section))
    return kept.withColumn("place", place).where(F.col("place") <= most)


def section_relevance(title: Column, score: Column, rejected: Column, overview: str) -> Column:
    """(score, relevant): an overview's score is 2.5 at least; a section with a rejecting sign is never relevant."""
    floored = F.when(title.rlike(overview), F.greatest(score, F.lit(2.5))).otherwise(score)
    return F.struct(floored.alias("score"), (~rejected & (floored >= 2.5)).alias("relevant"))


# Attributes of any element that may hold an address, and what looks like one inside a script.
ADDRESS_ATTRIBUTES = ("href", "src", "data-href", "data-url", "data-file", "data-download", "data-document", "onclick", "value")
PLAIN_ADDRESS = r"(?i)^(https?://|/|\./|\.\./)[^\s()'\"]*$"
SCRIPT_ADDRESS = r"(?i)(?:https?://[^\"'\s)]+|/[^\"'\s)]+\\?\.pdf(?:\?[^\"'\s)]*)?)"


def mined_addresses(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, link, context): https addresses in attributes of any element of a page, inside scripts there too, on the page's
    own site; of each the longest context (the attribute's value), in page order."""
    rows = pages.select(key, F.col(url).alias("base"), F.posexplode(W.tags(F.col(html))).alias("n", "tag"))
    wanted = F.filter(W.attributes(F.col("tag")), lambda a: a["name"].isin(*ADDRESS_ATTRIBUTES))
    rows = rows.select(key, "base", "n", wanted.alias("own")).where(F.size("own") > 0)
    rows = rows.select(key, "base", "n", F.posexplode(W.unescaped(F.transform("own", lambda a: a["value"]))).alias("i", "value")).where(r"value rlike '(?U)\\S'")
    bare = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    own = F.when(bare.rlike(PLAIN_ADDRESS), F.array(bare)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("href", F.explode(F.array_distinct(F.concat(own, F.regexp_extract_all("value", F.lit(SCRIPT_ADDRESS), 0)))))
    rows = rows.withColumn("link", W.resolved(F.col("base"), F.col("href"))).where("startswith(link, 'https://')")
    rows = rows.where(same_site(host(F.col("link")), host(F.col("base"))))
    place = F.struct("n", "i")
    rows = rows.withColumn("ord", place)
    found = rows.groupBy(key, "link").agg(F.max(F.struct(F.length("value").alias("size"), (-F.col("n")).alias("n"), (-F.col("i")).alias("i"), F.col("value").alias("value"))).alias("best"), F.min("ord").alias("ord"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("ord", "link"))
    return found.select(key, "link", F.col("best.value").alias("context"), (number - 1).cast("long").alias("ord"))


def first_passing(candidates: DataFrame, key: str, tier: str, score: str, link: str, passes: Column) -> DataFrame:
    """Of each key the candidate to take: of the first tier in which one passes the gate, the best score, then the last
    address. The gate is asked of all candidates at once; a key without one that passes has no row."""
    rank = F.struct(-F.col(tier), F.col(score), F.col(link))
    best = candidates.where(passes).groupBy(key).agg(F.max_by(F.struct(*candidates.columns), rank).alias("_best"))
    return best.select("_best.*")
