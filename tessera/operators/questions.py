"""Many questions against one catalogue: what each question matches, what a search finds, and the context of an answer.

Questions and items meet through indexes of their tokens, never all with all. Items with the same tokens are one profile, of
which only the first few names can be among a question's best; questions with the same tokens of the catalogue are asked once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import acronyms, chat_tokens, pieces, tokens
from ..sources.tables import materialise
from .profiles import QUESTION_WORDS, fact_lines
from .relational import latest
from .rules import evaluate, placed, with_rules


def matched(questions: DataFrame, key: str, message: str, items: DataFrame, item: str, name: str, description: str, most: int = 3) -> DataFrame:
    """(key, item, name, overlap, place): for each question the `most` items that share the most words with it, place 1 the
    best, in the order of names (then of the item's key) where equal.

    An item's words are those of its name and the name's acronyms; one whose description alone shares a word counts 1. Null
    and blank messages, and messages of stop words only, match nothing. A key that is repeated is one question for each row,
    so its rows repeat too. What is worked on grows with the different token sets on either side that share a token."""
    word = lambda c: chat_tokens(F.coalesce(c, F.lit("")), QUESTION_WORDS)
    own = F.array_sort(F.array_distinct(F.concat(word(F.col(name)), acronyms(F.col(name)))))
    rows = items.select(F.col(item).alias("_item"), F.col(name).alias("_name"), own.alias("_own"), F.array_sort(word(F.col(description))).alias("_told"))
    place = F.row_number().over(Window.partitionBy("_own", "_told").orderBy("_name", "_item"))
    first = rows.withColumn("_p", place).where(F.col("_p") <= most)
    profiles = first.groupBy("_own", "_told").agg(F.array_sort(F.collect_list(F.struct("_name", "_item"))).alias("_first"))
    profiles = materialise(profiles, "profiles")

    strong = profiles.select("_own", "_told", F.explode("_own").alias("_token"), F.lit(1).alias("_strong"))
    weak = profiles.select("_own", "_told", F.explode(F.array_except("_told", "_own")).alias("_token"), F.lit(0).alias("_strong"))
    index = strong.unionByName(weak)
    numbered = questions.select(key, message).withColumn("_row", F.monotonically_increasing_id())  # used in one plan only, which writes it down
    asked = numbered.select("_row", key, F.explode(word(F.col(message))).alias("_token")).join(index.select("_token").distinct(), "_token", "left_semi")
    asked = materialise(asked.groupBy("_row", key).agg(F.array_sort(F.collect_list("_token")).alias("_ask")), "asked")

    met = asked.select("_ask").distinct().withColumn("_token", F.explode("_ask")).join(index, "_token")
    score = F.greatest(F.sum("_strong"), F.lit(1)).cast("long")
    found = met.groupBy("_ask", "_own", "_told").agg(score.alias("overlap"))
    names = found.join(profiles.select("_own", "_told", "_first"), ["_own", "_told"]).select("_ask", "overlap", F.inline("_first"))
    rank = F.row_number().over(Window.partitionBy("_ask").orderBy(F.desc("overlap"), "_name", "_item"))
    best = names.withColumn("place", rank).where(F.col("place") <= most)
    return asked.join(best, "_ask").select(key, F.col("_item").alias(item), F.col("_name").alias(name), "overlap", "place")


def searched(questions: DataFrame, key: str, message: str, items: DataFrame, item: str, name: str, haystack: str) -> DataFrame:
    """(key, item): every item that a search finds: its text (haystack) contains the whole message, or each of the message's
    tokens is in the text or is an acronym of the name; without regard to case.

    The longest token of a message (its text, if it has none) has to be in an item's text, so all its pieces of three
    characters are; questions meet the items in whose index the rarest of these stands, or that have the token as an acronym,
    and only these are looked at. Items with the same text and acronyms are looked at once. Null and blank messages find every item: they are left out here, as the answer is the
    catalogue itself. Repeated keys and messages are questions of their own."""
    text = F.lower(F.coalesce(F.col(haystack), F.lit("")))
    every_item = items.select(F.col(item), text.alias("_text"), acronyms(F.col(name)).alias("_short"))
    rows = materialise(every_item.select("_text", "_short").distinct().withColumn("_id", F.monotonically_increasing_id()), "catalogue")  # written down once
    index = rows.select("_id", F.explode(F.concat(*[pieces(F.col("_text"), F.lit(n)) for n in (1, 2, 3)])).alias("_gram"))
    index = index.unionByName(rows.select("_id", F.explode(F.transform("_short", lambda x: F.concat(F.lit("=  "), x))).alias("_gram")))  # no piece is so long
    counts = materialise(index.groupBy("_gram").agg(F.count("*").alias("_n")), "grams")

    asked = questions.select(F.col(key), F.trim(F.lower(message)).alias("_whole"), F.monotonically_increasing_id().alias("_row")).where("_whole <> ''")
    asked = materialise(asked.withColumn("_words", tokens(F.col("_whole"))), "asked")
    longest = F.array_max(F.transform("_words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    probe = F.coalesce(longest, F.col("_whole"))
    looked = asked.withColumn("_probe", probe).withColumn("_pieces", pieces(F.col("_probe"), F.least(F.length("_probe"), F.lit(3))))
    # A piece that no item has rules the text out, so pieces without a count are rarest of all.
    rarest = looked.select("_row", F.explode("_pieces").alias("_gram")).join(counts, "_gram", "left").groupBy("_row").agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    keys = rarest.unionByName(looked.select("_row", F.concat(F.lit("=  "), "_probe").alias("_gram")))
    pairs = keys.join(index, "_gram").select("_row", "_id").distinct().join(asked, "_row").join(rows, "_id")
    every = (F.size("_words") > 0) & F.forall("_words", lambda w: F.contains("_text", w) | F.array_contains("_short", w))
    found = pairs.where(F.contains("_text", F.col("_whole")) | every).select(key, "_text", "_short")
    return found.join(every_item, ["_text", "_short"]).select(key, item)


def rule_lines(groups: DataFrame, rules: DataFrame) -> DataFrame:
    """(notice, rule_lines): a notice's groups that have rules of their own as lines in tree order, two spaces a level."""
    own = F.array_sort(F.collect_list(F.struct("rule_id", F.concat_ws(" ", "attribute", "operator", "value").alias("told"))))
    tree = placed(with_rules(groups, rules, told=F.transform(own, lambda r: r["told"])), "logical_operator", "told")

    def line(g: Column) -> Column:
        joined = F.array_join(g["told"], "\0")
        text = F.concat(F.repeat(F.lit("  "), g["depth"]), F.lit("- ("), g["logical_operator"], F.lit(") "), joined)
        return F.struct(g["path"].alias("path"), F.replace(text, F.lit("\0"), F.concat(F.lit(" "), g["logical_operator"], F.lit(" "))).alias("line"))

    lines = F.array_sort(F.transform(F.filter("tree", lambda g: g["told"].isNotNull()), line))
    return tree.select("notice", lines.alias("lines")).where(F.size("lines") > 0).select("notice", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("rule_lines"))


def exam_facts(exams: DataFrame, notices: DataFrame, dates: DataFrame, groups: DataFrame, rules: DataFrame) -> DataFrame:
    """exams (exam_id, name, type, description, url) with facts (lines), title (of the notice they are from) and rules_notice.

    Facts come from the newest approved notice (notification_id, exam_id, title, release_date, application_start_date,
    application_end_date, summary, approval_status): the latest release_date, then the smallest notification_id; without a
    dated one the one with the smallest id. The rules are those of the notice that evaluation takes."""
    approved = notices.where("approval_status = 'APPROVED'")
    told = ["notification_id", "title", "release_date", "application_start_date", "application_end_date", "summary"]
    order = F.struct(F.col("release_date").isNotNull(), F.coalesce("release_date", F.lit("0001-01-01").cast("date")), -F.col("notification_id"))
    shown = approved.groupBy("exam_id").agg(F.max_by(F.struct(*told), order).alias("n"))
    window = F.struct("start_date", "exam_date_id", F.format_string("Exam date window: %s to %s", F.col("start_date").cast("string"), F.col("end_date").cast("string")).alias("line"))
    windows = dates.groupBy("notification_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(window)), lambda w: w["line"]), "\n").alias("windows"))
    ruled = latest(approved, "exam_id", F.coalesce("release_date", F.lit("0001-01-01").cast("date")), "notification_id").select("exam_id", F.col("notification_id").alias("rules_notice"))

    rows = exams.join(shown, "exam_id", "left").join(windows, F.col("n.notification_id") == windows["notification_id"], "left").drop(windows["notification_id"])
    rows = rows.join(ruled, "exam_id", "left").join(rule_lines(groups, rules).withColumnRenamed("notice", "rules_notice"), "rules_notice", "left")
    head = fact_lines([("EXAM", F.col("name")), ("Type", F.col("type")), ("Description", F.col("description")), ("Official page", F.col("url"))])
    none = F.lit("No approved official notification is on file for this exam yet, so specific dates/eligibility rules are not available.")
    day = lambda label, c: (label, F.col(f"n.{c}").cast("string"))
    stated = fact_lines(
        [
            ("Latest official notification", F.col("n.title")),
            day("Notification release date", "release_date"),
            day("Application start date", "application_start_date"),
            day("Application end date", "application_end_date"),
        ]
    )
    rest = F.array_compact(F.array(F.nullif(stated, F.lit("")), F.col("windows"), F.nullif(fact_lines([("Notification summary", F.col("n.summary"))]), F.lit("")), F.concat(F.lit("Eligibility rules:\n"), "rule_lines")))
    facts = F.concat_ws("\n", head, F.when(F.col("n").isNull(), none).otherwise(F.array_join(rest, "\n")))
    return rows.select(*exams.columns, facts.alias("facts"), F.col("n.title").alias("title"), "rules_notice")


def answer_contexts(
    questions: DataFrame, exams: DataFrame, notices: DataFrame, dates: DataFrame, groups: DataFrame, rules: DataFrame, applicants: DataFrame, flags: DataFrame, most: int = 3
) -> DataFrame:
    """questions (question_id, student_id, message) -> question_id, profile, details, sources, grounded: what an answer may use.

    details has for each matched exam its facts and, for a question with a known student (applicants: student_id, facts, work),
    the verdict with its reasons; a notice without rules, or with a rule that can't be evaluated, gives none. profile says what
    the student has filled in (flags), '' without a student. sources are the matched exams, best first; grounded, whether there
    is any. Blank messages get neither. Each student and notice is evaluated once, however many questions ask."""
    found = matched(questions, "question_id", "message", exams, "exam_id", "name", "description", most)
    found = found.join(questions.select("question_id", "student_id"), "question_id")
    facts = materialise(exam_facts(exams, notices, dates, groups, rules), "facts")
    rows = materialise(found.drop("name").join(facts, "exam_id"), "matched")
    pairs = rows.where("rules_notice is not null").select("student_id", F.col("rules_notice").alias("notice")).distinct().join(applicants.dropDuplicates(["student_id"]), "student_id")
    verdicts = evaluate(pairs, groups, rules).where("eval_error is null").withColumnRenamed("notice", "rules_notice")
    word = F.when(F.col("eligible"), "ELIGIBLE").otherwise("NOT ELIGIBLE")
    told = F.concat(F.lit("This student's computed eligibility: "), word, F.lit(". Reasons: "), F.array_join("reasons", "; "))
    rows = rows.join(verdicts.select("student_id", "rules_notice", told.alias("verdict")), ["student_id", "rules_notice"], "left")
    block = F.struct("place", F.concat_ws("\n", "facts", "verdict").alias("block"), F.struct("exam_id", "name", "title", "url").alias("source"))
    blocks = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(block), lambda a, b: a["place"] - b["place"]).alias("blocks"))

    said = lambda c, yes="saved", no="not saved": F.when(F.col(c), yes).otherwise(no)
    profile = F.format_string(
        "STUDENT PROFILE STATUS: date of birth %s; nationality %s; state %s; academic details %s.",
        said("has_date_of_birth"), said("has_nationality"), said("has_state"), said("has_academics", "added", "not added"),
    )
    known = flags.select("student_id", profile.alias("profile"))
    out = questions.select("question_id", "student_id").join(known, "student_id", "left").join(blocks, "question_id", "left")
    details = F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n")
    sources = F.coalesce(F.transform("blocks", lambda b: b["source"]), F.expr("cast(array() as array<struct<exam_id: bigint, name: string, title: string, url: string>>)"))
    return out.select("question_id", F.coalesce("profile", F.lit("")).alias("profile"), F.coalesce(details, F.lit("")).alias("details"), sources.alias("sources"), F.col("blocks").isNotNull().alias("grounded"))
