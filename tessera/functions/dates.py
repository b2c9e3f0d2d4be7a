"""Date functions as Column builders: dates in prose, age limits as birth-date bounds, tiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# How months, days, lists and ranges of days are written in prose.
_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_DAY = r"\d{1,2}(?:st|nd|rd|th)?"
_DAYS = rf"{_DAY}(?:\s*(?:,|&|and|to|-|–|—)\s*{_DAY})*"
MONTH_DAYS = rf"(?i)\b{_MONTH}\s+{_DAYS}\s*,?\s*\d{{4}}\b"
DAYS_MONTH = rf"(?i)\b{_DAYS}\s+(?:of\s+)?{_MONTH}\s*,?\s*\d{{4}}\b"
MONTH_TO_MONTH = rf"(?i)\b{_MONTH}\s+{_DAY}(?:\s*,?\s*\d{{4}})?\s*(?:to|-|–|—)\s*{_MONTH}\s+{_DAY}\s*,?\s*\d{{4}}\b"
ISO = r"\b\d{4}-\d{2}-\d{2}\b"
NUMERIC = r"\b\d{1,2}[/.\-]\d{1,2}[/.\-](?:\d{4}|\d{2})\b"
# The months' first three letters.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def day_of(year: Column, month: Column, day: Column) -> Column:
    """The date, null when the calendar has no such day. Days are checked by number: a parser that refuses one raises an error
    inside, which costs more than all the rest."""

    def checked(parts: Column) -> Column:
        y, m, d = (F.get(parts, i) for i in range(3))
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
        return F.when(y.between(0, 9999) & m.between(1, 12) & d.between(1, last), F.make_date(y, m, d))

    return let(F.array(year, month, day), checked)


def month_number(text: Column) -> Column:
    """1 to 12 for the first month's name in text."""
    name = F.lower(F.substring(F.regexp_extract(text, f"(?i){_MONTH}", 0), 1, 3))
    return F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int")


def full_year(year: Column) -> Column:
    return F.when(year < 100, year + 2000).otherwise(year)


def expand_days(days: Column) -> Column:
    """`6-8` and `6 to 8` are all days between; any other list is itself."""

    def spread(d: Column) -> Column:
        between = d.rlike(r"(?i)\bto\b|[-–—]")
        ranged = lambda n: (F.size(n) == 2) & between & (F.get(n, 0) < F.get(n, 1)) & (F.get(n, 1) <= 31)
        numbers = F.transform(F.regexp_extract_all(d, F.lit(r"\d{1,2}"), 0), lambda x: x.cast("int"))
        return let(numbers, lambda n: F.when(ranged(n), F.sequence(F.get(n, 0), F.get(n, 1))).otherwise(n))

    return let(days, spread)


def _listed(match: Column) -> Column:
    """The dates of one month with a list of days, in either order."""
    year = F.regexp_extract(match, r"(\d{4})$", 1).cast("int")
    days = F.regexp_replace(F.regexp_replace(match, r"\s*,?\s*\d{4}$", ""), rf"(?i){_MONTH}", "")
    parts = F.struct(year.alias("year"), month_number(match).alias("month"), expand_days(days).alias("days"))
    return let(parts, lambda x: F.transform(x["days"], lambda d: day_of(x["year"], x["month"], d)))


def _range(match: Column) -> Column:
    """First and last day of a range between months; a missing first year is the last one."""
    parts = rf"(?i)({_MONTH})\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:\s*,?\s*(\d{{4}}))?\s*(?:to|-|–|—)\s*({_MONTH})\s+(\d{{1,2}})(?:st|nd|rd|th)?\s*,?\s*(\d{{4}})"
    g = lambda k: F.regexp_extract(match, parts, k)
    last = g(6).cast("int")
    first = F.coalesce(F.nullif(g(3), F.lit("")).cast("int"), last)
    return F.array(day_of(first, month_number(g(1)), g(2).cast("int")), day_of(last, month_number(g(4)), g(5).cast("int")))


def _numeric(match: Column) -> Column:
    numbers = F.transform(F.split(match, r"[/.\-]"), lambda x: x.cast("int"))
    return let(numbers, lambda n: F.array(day_of(full_year(F.get(n, 2)), F.get(n, 1), F.get(n, 0))))


def _iso(match: Column) -> Column:
    numbers = F.transform(F.split(match, "-"), lambda x: x.cast("int"))
    return let(numbers, lambda n: F.array(day_of(F.get(n, 0), F.get(n, 1), F.get(n, 2))))


# How a month's name begins; the patterns of dates, each after what every match of it has in it, which is looked
# for first, as most texts have none.
_BEGINS = f"(?:{'|'.join(MONTHS)})"
EVERY = [
    (rf"(?i){_BEGINS}[a-z]*\.?\s+[0-9]", MONTH_DAYS, _listed),
    (rf"(?i)[0-9](?:st|nd|rd|th)?\s+(?:of\s+)?{_BEGINS}", DAYS_MONTH, _listed),
    (rf"(?i)[0-9](?:st|nd|rd|th)?\s*(?:to|-|–|—)\s*{_BEGINS}", MONTH_TO_MONTH, _range),
    ("[0-9]-[0-9]{2}-[0-9]", ISO, _iso),
    ("[0-9][/.-][0-9]{1,2}[/.-][0-9]", NUMERIC, _numeric),
]


def find_dates(text: Column) -> Column:
    """All dates of a text, pattern by pattern, repeats kept, impossible days left out; numeric ones are day first."""

    def found(t: Column) -> Column:
        dates = [F.when(t.rlike(mark), F.flatten(F.transform(F.regexp_extract_all(t, F.lit(pattern), 0), read))).otherwise(F.array().cast("array<date>")) for mark, pattern, read in EVERY]
        return F.when(t.isNotNull(), F.array_compact(F.concat(*dates)))

    return let(text, found)


def date_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(find_dates(text)))


# The written forms of one date that are read: year first; day first with / . or - and a year of four or two
# digits (69 to 99 are 19xx, others 20xx); day, month's name or its first three letters, year, in both orders, the comma
# before the year or not.
YEAR_FIRST = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
DAY_FIRST = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4}|\d{2})$"
DAY_NAMED = r"^(\d{1,2})\s+([a-z]+),?\s+(\d{4})$"
NAMED_DAY = r"^([a-z]+)\s+(\d{1,2}),?\s+(\d{4})$"
MONTH_NAMES = "january february march april may june july august september october november december".split()


def named_month(name: Column) -> Column:
    """1 to 12 for a month's whole name or its first three letters, null for other words."""
    whole = F.array_position(F.array(*map(F.lit, MONTH_NAMES)), name)
    short = F.array_position(F.array(*map(F.lit, MONTHS)), name)
    return F.nullif(F.greatest(whole, short), F.lit(0)).cast("int")


def normal_date(text: Column) -> Column:
    """One date out of a short text in any of the written forms, ordinal endings left out; null when it has none of them.

    Each form is turned into year, month and day, set apart by a control character, by one replacement; what has no form keeps its text and is no such triple."""
    bare = F.trim(F.regexp_replace(F.lower(F.trim(text)), r"(\d+)(st|nd|rd|th)", "$1"))
    for form, order in ((YEAR_FIRST, "$1\x01$2\x01$3"), (DAY_FIRST, "$4\x01$3\x01$1"), (DAY_NAMED, "$3\x01$2\x01$1"), (NAMED_DAY, "$3\x01$1\x01$2")):
        bare = F.regexp_replace(bare, form, order)

    def read(part: Column) -> Column:
        year, month, day = (F.get(part, i) for i in range(3))
        short = year.try_cast("int")
        full = F.when(F.length(year) == 4, short).otherwise(short + F.when(short >= 69, 1900).otherwise(2000))
        return F.when(F.size(part) == 3, day_of(full, F.coalesce(month.try_cast("int"), named_month(month)), day.try_cast("int")))

    return let(F.split(bare, "\x01"), read)


def subtract_years(day: Column, n: Column) -> Column:
    """29 February goes to 28 February."""
    return F.add_months(day, (n * -12).cast("int"))


def birth_bound(kind: Column, years: Column, at: Column, exclusive: Column) -> Column:
    """(operator, day): the rule on the date of birth that an age limit on a day stands for."""
    top = F.date_add(subtract_years(at, years + F.when(exclusive, 0).otherwise(1)), 1)
    low = subtract_years(at, years + F.when(exclusive, 1).otherwise(0))
    maximum = kind == "maximum"
    return F.struct(F.when(maximum, ">=").otherwise("<=").alias("operator"), F.when(maximum, top).otherwise(low).alias("day"))


def exclusive_wording(kind: Column, quote: Column) -> Column:
    """The wording leaves out the age it names: below 30, over 18."""
    top = quote.rlike(r"(?i)\b(?:less\s+than|below|under|younger\s+than|not\s+(?:have\s+)?(?:attained|completed))\s+(?:the\s+age\s+of\s+)?\d")
    low = quote.rlike(r"(?i)(?<!not )(?<!not be )\b(?:more\s+than|older\s+than|above|over)\s+(?:the\s+age\s+of\s+)?\d")
    return F.coalesce(F.when(kind == "maximum", top).otherwise(low), F.lit(False))


def tier(days_left: Column) -> Column:
    return F.when(days_left <= 1, 1).when(days_left <= 3, 3).otherwise(7)


def days_until(moment: Column, now: Column) -> Column:
    """Days up to a moment, a begun day counts."""
    return F.ceil((F.unix_timestamp(moment) - F.unix_timestamp(now)) / 86400)


def only_one(days: Column) -> Column:
    """The one distinct day of an array; null when there are none or several."""
    d = F.array_distinct(days)
    return F.when(F.size(d) == 1, F.get(d, 0))


def first_date(text: Column) -> Column:
    """The date that stands first in a text; null without one."""
    kinds = [(MONTH_DAYS, _listed), (DAYS_MONTH, _listed), (MONTH_TO_MONTH, _range), (ISO, _iso), (NUMERIC, _numeric)]
    found = [F.struct(F.regexp_instr(text, F.lit(p)).alias("at"), F.get(f(F.nullif(F.regexp_extract(text, p, 0), F.lit(""))), 0).alias("day")) for p, f in kinds]
    return F.array_min(F.filter(F.array(*found), lambda x: (x["at"] > 0) & x["day"].isNotNull()))["day"]


# The wording of birth-date limits, looked for in the 260 characters from `born` on; the date stands within 45.
BORN = r"(?is)(?=(\bborn\b.{0,256}))"
EARLIEST = r"(?is)(?:born\s+)?(?:not\s+earlier\s+than|on\s+or\s+after|not\s+before)\s*(?=(.{0,45}))"
LATEST = r"(?is)(?:not\s+later\s+than|on\s+or\s+before|not\s+after)\s*(?=(.{0,45}))"


def birth_limits(text: Column) -> Column:
    """(earliest, latest, varies): the birth-date limits that a text states after `born`, the widest of several, and whether
    there are several different ones."""
    windows = F.regexp_extract_all(text, F.lit(BORN), 1)
    days = lambda form: F.array_distinct(F.array_compact(F.flatten(F.transform(windows, lambda w: F.transform(F.regexp_extract_all(w, F.lit(form), 1), first_date)))))
    low, high = days(EARLIEST), days(LATEST)
    return F.struct(F.array_min(low).alias("earliest"), F.array_max(high).alias("latest"), ((F.size(low) > 1) | (F.size(high) > 1)).alias("varies"))


# How dates and times are written in lines of notices (the first form that fits a place is taken), words that
# lead to a time, and the forms in which a time is read.
_NAMED = "(?:January|Jan|February|Feb|March|Mar|April|Apr|May|June|Jun|July|Jul|August|Aug|September|Sep|October|Oct|November|Nov|December|Dec)"
LINE_DATE = rf"(?i)\d{{1,2}}(?:st|nd|rd|th)?\s+{_NAMED}[, ]+\d{{4}}|{_NAMED}\s+\d{{1,2}}[, ]+\d{{4}}|\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}[/-]\d{{1,2}}[/-]\d{{1,2}}"
TIME = r"(?i)\b(?:\d{1,2}:\d{2}(?::\d{2})?|\d{1,2}\s*(?:AM|PM)|\d{1,2}:\d{2}\s*(?:AM|PM)|24:00(?::00)?)\b"
LEADS_TO_TIME = r"(?i)\s+(?:at|up to|till|until)\s*$"
HALF_DAY = r"^(1[0-2]|0[1-9]|[1-9])(?::([0-5]\d))?\s+([AP]M)$"
WHOLE_DAY = r"^(2[0-3]|[0-1]\d|\d):([0-5]\d)(?::[0-5]\d)?$"
_YEAR_MARKED = r"^(\d{4})([/.-])(\d{1,2})\2(\d{1,2})$"


def moment(text: Column) -> Column:
    """(date, time) of a short text with one date and, before or after it, maybe a time of day: an ISO date and HH:MM, 24:00
    kept as it is. Null when the rest is no date; time is null when there is none or it can't be read. Of several times the
    first is taken; a time is read without what follows it, so an AM or PM behind minutes leaves the rest no date."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?i)(\d{1,2})(?:st|nd|rd|th)", "$1")
    time = F.regexp_extract(bare, TIME, 0)

    def without(parts: Column) -> Column:
        at = F.position(parts["time"], parts["bare"])
        rest = F.concat(F.substring(parts["bare"], F.lit(1), at - 1), F.substring(parts["bare"], at + F.length(parts["time"]), F.length(parts["bare"])))
        rest = F.regexp_replace(F.regexp_replace(rest, r"(?U)^\s+|\s+$", ""), LEADS_TO_TIME, "")
        return F.when(parts["time"] == "", parts["bare"]).otherwise(F.regexp_replace(rest, r"^[ ,.\-]+|[ ,.\-]+$", ""))

    rest = let(F.struct(bare.alias("bare"), time.alias("time")), without)
    day = let(rest, lambda r: normal_date(F.regexp_replace(r, _YEAR_MARKED, "$1-$3-$4")))
    said = F.upper(F.trim(time))
    hour, minute, half = (F.regexp_extract(said, HALF_DAY, k) for k in (1, 2, 3))
    clock = hour.try_cast("int") % 12 + F.when(half == "PM", 12).otherwise(0)
    read = (
        F.when(said.rlike("^24:00(:00)?$"), "24:00")
        .when(half != "", F.concat(F.lpad(clock.cast("string"), 2, "0"), F.lit(":"), F.when(minute == "", "00").otherwise(minute)))
        .when(said.rlike(WHOLE_DAY), F.concat(F.lpad(F.regexp_extract(said, WHOLE_DAY, 1), 2, "0"), F.lit(":"), F.regexp_extract(said, WHOLE_DAY, 2)))
    )
    return let(day, lambda d: F.when(d.isNotNull(), F.struct(F.date_format(d, "yyyy-MM-dd").alias("date"), read.alias("time"))))


def dated_lines(text: Column) -> Column:
    """(date, time, context) of every date in a text, line by line in order, context being its line; what can't be read is left
    out."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x.rlike("[0-9]"))

    def of_line(line: Column) -> Column:
        read = F.transform(F.regexp_extract_all(line, F.lit(LINE_DATE), 0), moment)
        return F.transform(F.array_compact(read), lambda m: F.struct(m["date"].alias("date"), m["time"].alias("time"), line.alias("context")))

    return F.flatten(F.transform(lines, of_line))
