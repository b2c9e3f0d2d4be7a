"""From extracted facts to dates and rule rows: normalised, grounded in the document, contradictions as issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import birth_bound, date_set, find_dates, let, normal_date, subtract_years
from ..functions.numbers import shown
from ..functions.text import LEVEL_ORDER, attribute_label, canonical, country, digits, grounding, operator_symbol, word_list

#: The levels as rules name them, lowest first.
LEVEL_NAMES = ("10th", "12th / Senior Secondary", "Diploma", "Bachelor's", "Master's", "PhD")


def compile_dates(facts: DataFrame, key: str, start: str, end: str, text: Column | None = None, known_days: Column | None = None) -> DataFrame:
    """facts with start_day and end_day in order (swapped says if they were not), grounded (every day is among the text's
    dates) and unreadable (the start is no date). Where facts share a text, known_days are its dates, read once (date_set)."""
    a, b = normal_date(F.col(start)), normal_date(F.col(end))
    rows = facts.withColumns({"_a": a, "_b": b, "_all": date_set(text) if known_days is None else known_days})
    turned = F.coalesce(F.col("_b") < F.col("_a"), F.lit(False))
    days = F.array_compact(F.array("_a", "_b"))
    known = (F.size(days) > 0) & F.forall(days, lambda x: F.array_contains("_all", x))
    return rows.select(
        *facts.columns,
        F.when(turned, F.col("_b")).otherwise(F.col("_a")).alias("start_day"),
        F.when(turned, F.col("_a")).otherwise(F.col("_b")).alias("end_day"),
        turned.alias("swapped"),
        F.coalesce(known, F.lit(False)).alias("grounded"),
        F.col("_a").isNull().alias("unreadable"),
    )


def expand_levels(levels: Column, or_higher: Column) -> Column:
    """Canonical level names; with or_higher all from the lowest named one up."""
    names = F.array(*map(F.lit, LEVEL_NAMES))
    ranks = F.filter(F.transform(levels, lambda x: F.array_position(F.array(*map(F.lit, LEVEL_ORDER)), canonical(x))), lambda r: r > 0)
    lowest = F.array_min(ranks)
    upward = F.slice(names, F.coalesce(lowest, F.lit(1)).cast("int"), F.lit(len(LEVEL_NAMES)))
    listed = F.array_distinct(F.transform(F.array_sort(ranks), lambda r: F.get(names, (r - 1).cast("int"))))
    return F.when(or_higher & (F.size(ranks) > 0), upward).otherwise(listed)


def compile_eligibility(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, rules) for each notice's facts: notice, as_of, minimum_age, maximum_age, exclusive, levels, or_higher,
    countries, cgpa, percentage. Group 1 is the AND root with the limits, 2 an OR of levels, 3 an OR of countries; what a
    notice has no fact for has no rule, and a group without a rule is not made. group_id = 4 * notice + place."""
    rule = lambda place, attribute, op, value, kind: F.struct(F.lit(place).alias("place"), F.lit(attribute).alias("attribute"), op.alias("operator"), value.cast("string").alias("value"), F.lit(kind).alias("data_type"))

    def limit(kind: str, years: str) -> Column:
        bound = birth_bound(F.lit(kind), F.col(years), F.col("as_of"), F.col("exclusive"))
        return F.when(F.col(years).isNotNull(), rule(1, "Date of Birth", bound["operator"], bound["day"], "date"))

    def least(attribute: str, name: str) -> Column:
        return F.when(F.col(name).isNotNull(), rule(1, attribute, F.lit(">="), shown(F.col(name)), "numeric"))

    levels = F.transform(expand_levels(F.col("levels"), F.col("or_higher")), lambda x: rule(2, "Qualification", F.lit("="), x, "text"))
    countries = F.transform(F.array_distinct(F.transform("countries", country)), lambda x: rule(3, "Nationality", F.lit("="), x, "text"))
    own = F.array_compact(F.array(limit("minimum", "minimum_age"), limit("maximum", "maximum_age"), least("CGPA", "cgpa"), least("Percentage", "percentage")))
    rows = facts.select("notice", F.posexplode(F.concat(own, levels, countries)).alias("ord", "r")).select("notice", "ord", "r.*")
    rows = rows.withColumn("group_id", F.col("notice") * 4 + F.col("place"))
    rules = rows.select((F.col("notice") * 64 + F.col("ord")).alias("rule_id"), "group_id", "attribute", "operator", "value", "data_type")
    used = rows.select("notice", "place").distinct()
    roots = rows.select("notice", F.lit(1).alias("place")).distinct()
    groups = used.unionByName(roots).distinct().select(
        "notice",
        (F.col("notice") * 4 + F.col("place")).alias("group_id"),
        F.when(F.col("place") > 1, F.col("notice") * 4 + 1).alias("parent_group_id"),
        F.col("place").alias("group_number"),
        F.when(F.col("place") == 1, "AND").otherwise("OR").alias("logical_operator"),
    )
    return groups, rules


def quote_backs_value(value: Column, quote: Column) -> Column:
    """The quote has all numbers of the value and 85 % of its words."""
    words = F.array_distinct(word_list(grounding(value)))
    shared = F.size(F.array_intersect(words, word_list(grounding(quote)))) >= 0.85 * F.size(words)
    return F.coalesce((F.size(F.array_except(digits(value), digits(quote))) == 0) & (F.size(words) > 0) & shared, F.lit(False))


def quote_backs_date(day: Column, quote: Column) -> Column:
    return F.coalesce(F.array_contains(date_set(quote), day), F.lit(False))


def information_issues(name: Column, body: Column, opens: Column, closes: Column, released: Column) -> Column:
    """What is wrong with a notice's information: required names, order of its days."""
    checks = [
        F.when(F.coalesce(F.trim(name), F.lit("")) == "", "missing-name"),
        F.when(F.coalesce(F.trim(body), F.lit("")) == "", "missing-body"),
        F.when(closes < opens, "closes-before-it-opens"),
        F.when(released > opens, "released-after-opening"),
    ]
    return F.array_compact(F.array(*checks))


def ages_at(birth: Column, at: Column) -> Column:
    """Whole years between two days."""
    guess = F.year(at) - F.year(birth)
    return guess - F.when(subtract_years(at, guess) < birth, 1).otherwise(0)


# Wording of concessions, of limits for everybody, and of origin abroad.
CATEGORY = (
    r"(?i)\b(obc|sc|st|ews|pwd|pwbd|ph|women|female|male|reserved|categor\w*|"
    r"ex-?servicem[ae]n|servicem[ae]n|relaxation|relaxable|domicile|defence|"
    r"handicapped|disab\w*|scheduled|castes?|tribes?|backward|benchmark\w*|"
    r"widows?|divorced|government\s+servants?|departmental)\b"
)
GENERAL = r"(?i)\b(all|general|unreserved|ur|everyone|any|open)\b"
RELAXED = r"(?i)\b(relax\w*|up\s+to\s+a\s+maximum\s+of|in\s+the\s+case\s+of|(?:three|five|ten|\d+)\s+years?\s+(?:if|for|in))\b"
ORIGIN = r"(?i)\b(?:persons?\s+of\s+indian\s+origin|indian\s+origin|migrated\s+from|came\s+over\s+from)\b"


def is_general_limit(applies_to: Column, quote: Column) -> Column:
    """An age limit for everybody: what it says it applies to decides, else that its quote is no concession."""
    said, q = F.coalesce(F.trim(applies_to), F.lit("")), F.coalesce(quote, F.lit(""))
    return F.when(said.rlike(CATEGORY), False).when(said.rlike(GENERAL), True).otherwise(~(q.rlike(RELAXED) & q.rlike(CATEGORY)))


def mentions_age(sentence: Column, years: Column) -> Column:
    """The sentence names the age as a whole number beside years or age, and is no concession."""
    numbers = F.regexp_extract_all(sentence, F.lit(r"\d+"), 0)
    concession = sentence.rlike(RELAXED) & sentence.rlike(CATEGORY)
    return F.coalesce(~concession & F.array_contains(numbers, years.cast("string")) & sentence.rlike(r"(?i)\b(?:years?|yrs?|age)\b"), F.lit(False))


def recovered_sentence(text: Column, years: Column) -> Column:
    """The first sentence of a text that mentions the age; null without one."""
    return F.get(F.filter(F.split(text, r"(?<=[.;])\s+|\n"), lambda s: mentions_age(s, years)), 0)


def nationality_backed(name: Column, quote: Column) -> Column:
    """The quote has the country's name or its people's."""
    words = word_list(F.lower(F.coalesce(quote, F.lit(""))))
    return F.coalesce(F.exists(words, lambda w: country(w) == country(name)) | F.lower(quote).contains(country(name)), F.lit(False))


def without_origin_only(countries: Column, quote: Column) -> Column:
    """Countries but those that the quote names only after its `of Indian origin who migrated from` part; India stays."""
    q = F.lower(F.coalesce(quote, F.lit("")))
    head = F.regexp_replace(q, r"(?s)" + ORIGIN + ".*$", "")
    tail = F.substring(q, F.length(head) + 1, F.length(q))
    return F.filter(countries, lambda c: (F.lower(c) == "india") | ~tail.contains(F.lower(c)) | head.contains(F.lower(c)))


def pieces_around(lines: Column, i: Column, before: int, most: int) -> Column:
    """The pieces of at most `most` lines that hold line i and begin at most `before` lines above it."""
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(before)), lambda k: i - k), lambda s: s >= 0)
    return F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(i + 1, F.least(F.size(lines), s + most)), lambda e: F.array_join(F.slice(lines, s + 1, e - s), " "))))


# What a snippet has to say, and may not say, to back a date of the field.
DATE_WORDING = {
    "late-fee": (r"(?i)\b(?:late|extended|extension)\b", None),
    "start": (r"(?i)\b(?:open(?:ing)?|start(?:ing)?|commenc\w*|begin\w*|registration)\b", r"(?i)\b(?:late|extended|closing|last date)\b"),
    "end": (r"(?i)\b(?:clos(?:e|es|ed|ing)|last date|deadline|end date|registration)\b", r"(?i)\b(?:late|extended|with late fee)\b"),
}


def recovered_date_quote(text: Column, day: Column, field: str, before: int = 2, most: int = 4) -> Column:
    """The shortest snippet around a line with the day that says what the field needs, cut to 400 characters; null without one.
    A snippet has at most `most` lines and begins at most `before` lines above its line; of equally short ones the first.

    Dates are looked for once in each line, and then only in snippets that have the wording."""
    required, excluded = DATE_WORDING[field]
    has_day = lambda x: F.array_contains(find_dates(x), day)

    def backs(x: Column) -> Column:
        said = x.rlike(required)
        return (said & ~x.rlike(excluded) if excluded else said) & has_day(x)

    def found(lines: Column) -> Column:
        none = F.array().cast("array<string>")
        each = F.transform(lines, lambda line, i: F.when(has_day(line), F.filter(pieces_around(lines, i, before, most), backs)).otherwise(none))
        return F.aggregate(F.flatten(each), F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | (F.length(x) < F.length(a)), x).otherwise(a))

    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.left(let(lines, found), F.lit(400))


# What has to stand in a quote that backs a level; what says a Bachelor's itself; what says a higher level.
LEVEL_WORDING = {
    "10th": r"(?i)\b(?:10th|tenth|matric\w*|class\s*(?:x|10)\b|high\s+school)",
    "12th / Senior Secondary": r"(?i)(?:\b(?:12th|twelfth|10\s*\+\s*2|senior\s+secondary|higher\s+secondary|intermediate|hsc|class\s*(?:xii|12)\b)|\+\s*2\b)",
    "Diploma": r"(?i)\bdiploma\b",
    "Bachelor's": r"(?i)\b(?:bachelor\w*|graduat\w*|undergraduate|degree|btech|bsc|bca|b\.\s?(?:tech|e|sc|a|com|arch)\b)",
    "Master's": r"(?i)\b(?:master\w*|post\s*-?\s*graduat\w*|mtech|msc|mca|mba|m\.\s?(?:tech|e|sc|a)\b)",
    "PhD": r"(?i)\b(?:ph\.?\s?d|doctor\w*)",
}
BACHELOR_ITSELF = r"(?i)\b(?:bachelor\w*|undergraduate|btech|bsc|bca|b\.\s?(?:tech|e|sc|a|com|arch)\b)"
HIGHER_LEVEL = r"(?i)\b(?:master\w*|post\s*-?\s*graduat\w*|doctor\w*|ph\.?\s?d)"


def level_backed(level: Column, quote: Column) -> Column:
    """The quote speaks of the level; `degree` alone is no Bachelor's where a higher level is named."""
    said = F.lit(False)
    for name, pattern in LEVEL_WORDING.items():
        said = said | ((level == name) & quote.rlike(pattern))
    higher = (level == "Bachelor's") & ~quote.rlike(BACHELOR_ITSELF) & quote.rlike(HIGHER_LEVEL)
    return F.coalesce(said & ~higher, F.lit(False))


def normal_rule(rules: DataFrame) -> DataFrame:
    """rules with attribute, operator and value in their normal form, and `refused`: why a rule has none (an attribute that
    is not supported, age among them; an operator; a date of birth that can't be read), null for good ones."""
    label, symbol = attribute_label(F.col("attribute")), operator_symbol(F.col("operator"))
    born = normal_date(F.col("value"))
    why = (
        F.when(F.lower(F.trim("attribute")) == "age", F.lit("Age must be represented as Date of Birth"))
        .when(label.isNull(), F.concat(F.lit("Unsupported eligibility attribute: "), F.col("attribute")))
        .when(symbol.isNull(), F.concat(F.lit("Unsupported eligibility operator: "), F.trim("operator")))
        .when((label == "Date of Birth") & born.isNull(), F.concat(F.lit("Unable to normalize date: "), F.trim("value")))
    )
    value = F.when(label == "Date of Birth", F.date_format(born, "yyyy-MM-dd")).otherwise(F.trim("value"))
    keep = [c for c in rules.columns if c not in {"attribute", "operator", "value"}]
    return rules.select(*keep, label.alias("attribute"), symbol.alias("operator"), value.alias("value"), why.alias("refused"))


def exam_ranges(rows: DataFrame, doc: str, start: Column, end: Column, backed: Column, deadline: Column) -> DataFrame:
    """(doc, ranges, before_deadline): every document's backed ranges once, by start and end, and whether the first begins
    before applications end, which a reviewer has to see."""
    kept = rows.select(doc, F.when(backed, F.struct(start.alias("start"), end.alias("end"))).alias("r"), deadline.alias("d"))
    found = kept.groupBy(doc).agg(F.array_sort(F.collect_set("r")).alias("ranges"), F.max("d").alias("d"))
    return found.select(doc, "ranges", F.coalesce(F.get("ranges", 0)["start"] < F.col("d"), F.lit(False)).alias("before_deadline"))


def normal_information(rows: DataFrame, days: list[str]) -> DataFrame:
    """rows with each of the day columns (texts) as yyyy-MM-dd, null where it has no day, and `refused`: the columns whose text
    is there but can't be read; a caller refuses such an extraction as a whole."""
    read = {c: normal_date(F.col(c)) for c in days}
    bad = [F.when((F.coalesce(F.trim(c), F.lit("")) != "") & read[c].isNull(), c) for c in days]
    rows = rows.withColumn("refused", F.array_compact(F.array(*bad)))
    return rows.withColumns({c: F.date_format(read[c], "yyyy-MM-dd") for c in days})


# What a sentence has to say to be about who may apply.
ELIGIBILITY_CUE = (
    r"(?i)\b(?:eligib\w*|qualif\w*|must\s+(?:have|possess|hold)|shall\s+(?:have|possess|hold)|should\s+(?:have|possess|hold)|"
    r"required\s+to|currently\s+(?:studying|pursuing)|completed|degree\s+of)\b"
)


def recovered_qualifications(passages: DataFrame, doc: str, passage: str, text: str) -> DataFrame:
    """(doc, level, quote, passage): levels of education that a sentence of a document's passages asks for, each with the
    sentence, cut to 400 characters; of equal sentences the first. Sentences of fewer than 18 characters ask for nothing."""
    parts = F.split(F.col(text), r"(?<=[.;:])\s+|\n+")
    rows = passages.select(doc, passage, F.posexplode(parts).alias("n", "part")).withColumn("sentence", F.trim("part"))
    rows = rows.where((F.length("sentence") >= 18) & F.col("sentence").rlike(ELIGIBILITY_CUE))
    levels = F.filter(F.array(*map(F.lit, LEVEL_WORDING)), lambda level: level_backed(level, F.col("sentence")))
    found = rows.withColumn("level", F.explode(levels)).groupBy(doc, "level", "sentence").agg(F.min(F.struct(passage, "n")).alias("at"))
    return found.select(doc, "level", F.left("sentence", F.lit(400)).alias("quote"), F.col(f"at.{passage}").alias(passage))


def date_and_age_errors(opens: Column, closes: Column, ranges: Column, minimum: Column, maximum: Column) -> Column:
    """What contradicts itself in a notice's days (ranges: array of start and end) and ages."""
    backwards = F.transform(F.filter(ranges, lambda r: r["start"] > r["end"]), lambda r: F.lit("Exam start date is after exam end date."))
    checks = [
        F.array(F.when(opens > closes, "Application start date is after application end date.")),
        F.coalesce(backwards, F.array().cast("array<string>")),
        F.array(F.when(closes > F.array_min(F.transform(ranges, lambda r: r["start"])), "Application end date is after the examination begins.")),
        F.array(F.when(minimum > maximum, "Minimum age is greater than maximum age.")),
    ]
    return F.array_compact(F.concat(*checks))


def normal_extractions(information: DataFrame, rules: DataFrame, doc: str, days: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(information, rules, refused) of whole extractions in their normal form: a document is taken with all its days and rules
    or refused (doc, why) with each of its faults; all other columns, evidence too, stay as they are."""
    info, leaves = normal_information(information, days), normal_rule(rules)
    unread = info.select(doc, F.explode("refused").alias("column")).select(doc, F.concat(F.lit("Unable to normalize date: "), "column").alias("why"))
    refused = unread.unionByName(leaves.where("refused is not null").select(doc, F.col("refused").alias("why"))).distinct()
    kept = lambda x: x.join(refused, doc, "left_anti").drop("refused")
    return kept(info), kept(leaves), refused
