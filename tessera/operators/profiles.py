"""Applicants' profiles and what a question answering context says of them and of the exams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import shown
from ..functions.text import acronyms, chat_tokens

# Words of a question that tell no exam from another.
QUESTION_WORDS = (
    "the", "a", "an", "is", "am", "are", "for", "of", "in", "on",
    "to", "and", "or", "do", "does", "can", "i", "my", "me", "you",
    "what", "when", "where", "how", "which", "will", "be", "eligible",
    "eligibility", "exam", "exams", "apply", "application", "about",
    "tell", "please", "hi", "hello", "hey",
)


def with_profile(students: DataFrame, educations: DataFrame) -> DataFrame:
    """Students with a saved profile: a date of birth, or any education row."""
    rows = students.join(educations.select("student_id").distinct().withColumn("_any", F.lit(True)), "student_id", "left")
    return rows.where(F.col("date_of_birth").isNotNull() | F.col("_any")).drop("_any")


def profile_flags(students: DataFrame, educations: DataFrame) -> DataFrame:
    """What every student has filled in: date of birth, nationality, state, a current education. No values, flags only."""
    current = educations.where("is_current").select("student_id").distinct().withColumn("_now", F.lit(True))
    given = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(f"has_{c}")
    rows = students.join(current, "student_id", "left")
    return rows.select("student_id", given("date_of_birth"), given("nationality"), given("state"), F.coalesce("_now", F.lit(False)).alias("has_academics"))


def score_text(percentage: Column, cgpa: Column) -> Column:
    """How an education's result is shown: the percentage if there is one, else the CGPA."""
    return F.when(percentage.isNotNull(), F.concat(shown(percentage), F.lit("%"))).otherwise(shown(cgpa))


def relevant(items: DataFrame, key: str, name: str, description: str, question: str | Column, most: int = 3) -> DataFrame:
    """(key, name, overlap): the `most` items that share the most words with the question, in the order of names where equal.
    An item's words are those of its name and the name's acronyms; one whose description alone shares a word counts 1."""
    asked = chat_tokens(F.lit(question) if isinstance(question, str) else question, QUESTION_WORDS)
    own = F.array_distinct(F.concat(chat_tokens(F.coalesce(name, F.lit("")), QUESTION_WORDS), acronyms(F.col(name))))
    overlap = F.size(F.array_intersect(asked, own))
    told = F.arrays_overlap(asked, chat_tokens(F.coalesce(description, F.lit("")), QUESTION_WORDS))
    rows = items.select(key, name, F.when(overlap > 0, overlap).when(told, 1).otherwise(0).cast("long").alias("overlap"))
    return rows.where("overlap > 0").orderBy(F.desc("overlap"), name, key).limit(most)


def listed(items: DataFrame, name: str, ready: Column, most: int = 40) -> DataFrame:
    """(place, line): the first items by name, each with its state, under a headline with the number of all; then how many more."""
    first = items.select(F.col(name).alias("n"), ready.alias("r")).orderBy("n").limit(most)
    state = F.when(F.col("r"), "details available").otherwise("pending review")
    some = first.agg(F.array_sort(F.collect_list(F.struct("n", state.alias("s")))).alias("rows"))  # `most` rows
    total = items.agg(F.count("*").alias("total"))
    lines = F.transform("rows", lambda x: F.format_string("- %s (%s)", x["n"], x["s"]))
    more = F.when(F.col("total") > most, F.array(F.format_string("- ...and %d more", F.col("total") - most))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.when(F.col("total") == 0, "EXAMS: none yet.").otherwise(F.format_string("EXAMS (%d total):", F.col("total"))))
    return some.crossJoin(total).select(F.posexplode(F.concat(head, lines, more)).alias("place", "line"))  # one row each


def fact_lines(fields: list[tuple[str, Column]]) -> Column:
    """`label: value` lines of the fields that have a value, joined."""
    given = [F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}: "), value.cast("string"))) for label, value in fields]
    return F.array_join(F.array_compact(F.array(*given)), "\n")
