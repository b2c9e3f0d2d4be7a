"""Sign-up by a code sent to an address: keyed state over start, verify and resend requests, the same step for a batch replay
and for a stream.

Of each address the state is the waiting sign-up (when its code expires, wrong attempts, codes sent, the time of the last one,
when it began, the code) or that the address is registered. A code is good for ten minutes; a new one can be had a minute
after the last, five within an hour of the beginning; the fifth wrong code ends the sign-up; a day after its code expired it
is gone. Requests that send a code bring it along (`fresh`): making codes and mailing them is the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SECOND = 1_000_000
#: Code's life, cooldown and allowance's hour in seconds; wrong attempts, codes an hour; life after expiry in seconds.
LIFE, COOLDOWN, HOUR, ATTEMPTS, SENDS, KEPT = 600, 60, 3600, 5, 5, 86_400
#: Keys of a stream's state: addresses share one by their hash, so that what a group costs does not grow with the addresses.
SLOTS = 1024
STATE = "address array<string>, expires array<long>, attempts array<int>, sends array<int>, sent array<long>, began array<long>, code array<string>, registered array<boolean>"


@dataclass
class Waiting:
    """All times in microseconds."""

    expires: int = 0
    attempts: int = 0
    sends: int = 0
    sent: int = 0
    began: int = 0
    code: str | None = None
    registered: bool = False

    def gone(self, now: int) -> bool:
        return not self.registered and self.expires < now - KEPT * SECOND


def cooldown(state: Waiting, now: int) -> int:
    """Whole seconds until the next code may be sent, 0 if it may."""
    ready = state.sent + COOLDOWN * SECOND
    return (ready - now) // SECOND + 1 if ready > now else 0


def step(state: Waiting | None, now: int, action: str, code: str | None, fresh: str | None) -> tuple[Waiting | None, str]:
    """The next state and the answer: sent, wait:N, too-many, registered, none, expired, wrong:N (attempts left), locked or
    unknown-action."""
    if state is not None and state.gone(now):
        state = None
    if action not in ("start", "resend", "verify"):
        return state, "unknown-action"
    if state is not None and state.registered:
        return state, "none" if action != "start" else "registered"
    if action == "verify":
        if state is None:
            return None, "none"
        if state.expires < now:
            return state, "expired"
        if (code or "").strip() == state.code:
            return Waiting(registered=True), "registered"
        state.attempts += 1
        left = ATTEMPTS - state.attempts
        return (state, f"wrong:{left}") if left > 0 else (None, "locked")
    if state is None:
        if action == "resend":
            return None, "none"
        return Waiting(now + LIFE * SECOND, 0, 1, now, now, fresh), "sent"
    wait = cooldown(state, now)
    if wait:
        return state, f"wait:{wait}"
    young = state.began > now - HOUR * SECOND
    if young and state.sends >= SENDS:
        return state, "too-many"
    began, sends = (state.began, state.sends + 1) if young or action == "resend" else (now, 1)
    return Waiting(now + LIFE * SECOND, 0, sends, now, began, fresh), "sent"


def _rows(requests: DataFrame, key: str | Column, ident: str, at: str, action: str, code: str, fresh: str) -> DataFrame:
    """Addresses are compared trimmed and in lower case."""
    address = F.lower(F.trim(key)).alias("address")
    return requests.select(address, F.col(ident).alias("ident"), F.col(at).cast("timestamp").alias("t"), F.col(action).alias("action"), F.col(code).alias("code"), F.col(fresh).alias("fresh"))


def _answered(part: pd.DataFrame, states: dict[str | None, Waiting]) -> pd.DataFrame:
    """The requests of any addresses in order of time and ident; states are changed in place."""
    part = part.sort_values(["t", "ident"])
    text = lambda c: [None if missing else x for x, missing in zip(part[c], part[c].isna(), strict=True)]
    times, addresses, answers = part.t.astype("datetime64[us]").astype("int64").tolist(), text("address"), []
    for address, *request in zip(addresses, times, text("action"), text("code"), text("fresh"), strict=True):
        state, answer = step(states.pop(address, None), *request)
        if state is not None:
            states[address] = state
        answers.append(answer)
    return pd.DataFrame({"address": part.address, "ident": part.ident, "answer": answers})


_OUT = "address string, ident long, answer string"


def sign_ups(requests: DataFrame, key: str | Column, ident: str, at: str, action: str, code: str, fresh: str) -> DataFrame:
    """(address, ident, answer) of a table of requests, each address's in order of time and ident. The group that a task
    holds is one address's requests."""
    rows = _rows(requests, key, ident, at, action, code, fresh)
    return rows.groupBy("address").applyInPandas(lambda part: _answered(part, {}), _OUT)


def sign_up_stream(requests: DataFrame, key: str | Column, ident: str, at: str, action: str, code: str, fresh: str, late: str = "1 minute", slots: int = SLOTS) -> DataFrame:
    """The same over a stream, requests of an address at most `late` out of order. A waiting sign-up's state goes by a timer a
    day after its code expired; that an address is registered stays. Addresses with the same hash share a row of the state
    and its timer, which is set to the first of them to go; `slots` holds for the life of a checkpoint."""
    rows = _rows(requests, key, ident, at, action, code, fresh).withWatermark("t", late).withColumn("slot", F.pmod(F.xxhash64("address"), F.lit(slots)))

    def run(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        states = {address: Waiting(*values) for address, *values in zip(*held.get, strict=True)} if held.exists else {}
        if held.hasTimedOut:
            now = held.getCurrentWatermarkMs() * 1000
            states = {address: state for address, state in states.items() if not state.gone(now)}
        else:
            yield _answered(pd.concat(list(parts)), states)
        if not states:
            if held.exists:
                held.remove()
            return
        held.update(tuple(map(list, zip(*((address, *astuple(state)) for address, state in states.items()), strict=True))))
        waiting = [state.expires for state in states.values() if not state.registered]
        if waiting:
            held.setTimeoutTimestamp(max((min(waiting) + KEPT * SECOND) // 1000 + 1, held.getCurrentWatermarkMs() + 1))

    return rows.groupBy("slot").applyInPandasWithState(run, _OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
