"""Keyed state: a sliding-log limiter and a token bucket, the same step for a batch replay and for a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def limit_events(times: list[float], kept: list[float], most: int, span: float) -> tuple[list[bool], list[float]]:
    """Accept an event when fewer than most accepted ones are at most span old, in the unit of the times; rejected ones leave
    no trace."""
    out = []
    for t in times:
        kept = [k for k in kept if t - k <= span]
        out.append(len(kept) < most)
        if out[-1]:
            kept.append(t)
    return out, kept


def rate_limit(events: DataFrame, key: str, ident: str, at: str, most: int, seconds: float) -> DataFrame:
    """(key, ident, accepted) of a table of events, each key's in order of time and ident."""
    rows = events.select(key, ident, F.unix_micros(F.col(at).cast("timestamp")).alias("us"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["us", ident])
        accepted, _ = limit_events(part.us.tolist(), [], most, round(seconds * 1e6))
        return part.assign(accepted=accepted)[[key, ident, "accepted"]]

    return rows.groupBy(key).applyInPandas(run, f"{key} long, {ident} long, accepted boolean")


def rate_limit_stream(events: DataFrame, key: str, ident: str, at: str, most: int, seconds: float) -> DataFrame:
    """The same over a stream; a key's state is the accepted times (whole microseconds) that still count, and goes when none
    does. A key's rows of a micro-batch may come in several parts, which are put in order together."""
    rows = events.select(key, ident, F.col(at).cast("timestamp").alias("t"), F.unix_micros(F.col(at).cast("timestamp")).alias("us")).withWatermark("t", f"{int(seconds)} seconds")

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        part = pd.concat(list(parts)).sort_values(["us", ident])
        accepted, kept = limit_events(part.us.tolist(), kept, most, round(seconds * 1e6))
        yield pd.DataFrame({key: part[key], ident: part[ident], "accepted": accepted})
        state.update((kept,))
        if kept:
            state.setTimeoutTimestamp(max(int(max(kept) / 1000 + seconds * 1000) + 1, state.getCurrentWatermarkMs() + 1))

    return rows.groupBy(key).applyInPandasWithState(run, f"{key} long, {ident} long, accepted boolean", "kept array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def bucket_events(rows: list[tuple[float, float, float, bool]], capacity: float, refill: float) -> list[tuple[float, bool]]:
    """(wait, granted) of (time, cost, longest wait, is a penalty) in order. The bucket refills to its capacity; a grant may
    overdraw it by waiting; a penalty empties it; what is larger than the bucket is never granted."""
    level, last, out = capacity, None, []
    for t, cost, patience, penalty in rows:
        if last is not None:
            level = min(capacity, level + (t - last) * refill)
        last = t
        if penalty:
            level = min(level, 0.0)
            out.append((0.0, True))
            continue
        wait = max(0.0, (cost - level) / refill)
        granted = cost <= capacity and wait <= patience
        if granted:
            level -= cost
        out.append((wait, granted))
    return out


def token_bucket(events: DataFrame, key: str, ident: str, at: str, cost: str, patience: float, capacity: float, refill: float) -> DataFrame:
    rows = events.select(key, ident, F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.col(cost).cast("double").alias("cost"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["us", ident])
        done = bucket_events([(u / 1e6, c, patience, c < 0) for u, c in zip(part.us, part.cost, strict=True)], capacity, refill)
        return part.assign(wait=[round(w, 3) for w, _ in done], granted=[g for _, g in done])[[key, ident, "wait", "granted"]]

    return rows.groupBy(key).applyInPandas(run, f"{key} long, {ident} long, wait double, granted boolean")


def dedupe_stream(events: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """The first event of each key, for keys that come again within the delay; event time is cast to a zoned timestamp first."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts by tumbling event-time window, late events admitted up to a delay."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))


def single_flight(requests: DataFrame, key: Column, at: str, wait: str) -> DataFrame:
    """Of requests for the same thing (key in its normal form, kept as `flight`) the first alone; the others share its result.
    On a stream those that come within the wait of the first; a table is one batch, of which each key's earliest row stays."""
    rows = requests.withColumn("flight", F.lower(F.trim(F.regexp_replace(key, r"\s+", " "))))
    if rows.isStreaming:
        return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, wait).dropDuplicatesWithinWatermark(["flight"])
    return rows.groupBy("flight").agg(F.min_by(F.struct(*rows.columns), at).alias("_row")).select("_row.*")
