"""Number functions as Column builders: token estimates, scores, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def estimated_tokens(text: Column) -> Column:
    """Three characters a token, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(3.0)).cast("long")


def request_cost(texts: Column, schema: Column, output: Column) -> Column:
    """Tokens of a request: its messages and 8 for each, the answer's schema, and the longest answer."""
    messages = F.aggregate(texts, F.lit(0).cast("long"), lambda a, t: a + estimated_tokens(t) + 8)
    return messages + estimated_tokens(schema) + output


def parsed_score(text: Column) -> Column:
    """(percentage, cgpa): a number with % is the one, without the other."""
    number = F.regexp_replace(text, "%", "").try_cast("double")
    percent = text.contains("%")
    return F.struct(F.when(percent, number).alias("percentage"), F.when(~percent, number).alias("cgpa"))


def shown(number: Column) -> Column:
    """A number without a final .0"""
    return F.when(number == F.floor(number), F.floor(number).cast("long").cast("string")).otherwise(number.cast("string"))


def clamped(score: Column, low: float = -10, high: float = 15) -> Column:
    """Held to low..high and rounded half-even to two places."""
    return F.bround(F.greatest(F.lit(float(low)), F.least(score, F.lit(float(high)))), 2)


def bm25(freq: Column, length: Column, average: Column, n: Column, df: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    idf = F.ln(1 + (n - df + 0.5) / (df + 0.5))
    return idf * freq * (k1 + 1) / (freq + k1 * (1 - b + b * length / average))
