"""Keyed state: golden values, and streams against the batch replay."""

from __future__ import annotations

from tessera.streaming import state as S


def test_limiter_forgets_rejected_events():
    accepted, kept = S.limit_events([0, 1, 2, 600, 601, 602], [], 2, 600)
    assert accepted == [True, True, False, False, True, True] and kept == [601, 602]


def test_bucket():
    out = S.bucket_events([(0, 500, 1, False), (0, 400, 1, False), (0, 10_000, 1, False)], 600, 10)
    assert [g for _, g in out] == [True, False, False] and out[0][0] == 0 and out[1][0] > 1


def test_penalty_empties_the_bucket():
    out = S.bucket_events([(0, 100, 1, False), (0, 0, 1, True), (0, 100, 5, False), (0, 100, 20, False)], 600, 10)
    assert [g for _, g in out] == [True, True, False, True]


def test_late_delivery_status(spark):
    from pyspark.sql import functions as F

    from tessera.streaming.fanout import deliver

    rows = spark.createDataFrame([(1, "a@b.c", None), (2, "a@b.c", "x" * 900), (3, None, None)], "i long, email string, err string")
    got = {x.i: (x.email_status, x.email_error) for x in deliver(rows, F.col("err").isNotNull(), F.col("err"), F.col("email").isNotNull()).collect()}
    assert got == {1: ("SENT", None), 2: ("FAILED", "x" * 500), 3: ("SKIPPED", None)}


def plain_sign_ups(requests):
    """The rules one request at a time, over dictionaries."""
    waiting, registered, out = {}, set(), []
    for now, key, action, code, fresh in requests:
        w = waiting.get(key)
        if w and w["expires"] < now - 86_400:
            del waiting[key]
            w = None
        if action == "start" and key in registered:
            out.append("registered")
        elif action == "verify":
            if not w:
                out.append("none")
            elif w["expires"] < now:
                out.append("expired")
            elif code == w["code"]:
                registered.add(key)
                del waiting[key]
                out.append("registered")
            else:
                w["wrong"] += 1
                if w["wrong"] == 5:
                    del waiting[key]
                out.append("locked" if w["wrong"] == 5 else f"wrong:{5 - w['wrong']}")
        elif action == "resend" and not w:
            out.append("none")
        elif w and w["last"] + 60 > now:
            out.append(f"wait:{int(w['last'] + 60 - now) + 1}")
        elif w and w["began"] > now - 3600 and w["n"] >= 5:
            out.append("too-many")
        else:
            again = w and (action == "resend" or w["began"] > now - 3600)
            waiting[key] = {"expires": now + 600, "wrong": 0, "last": now, "code": fresh, "began": w["began"] if again else now, "n": w["n"] + 1 if again else 1}
            out.append("sent")
    return out


def requests_of(seed, n):
    import random

    r, now, out = random.Random(seed), 0, []
    for i in range(n):
        now += r.choice([0.25, 5, 20, 45, 61, 200, 700, 4000, 90_000] if r.random() < 0.5 else [5, 61])
        out.append((i, now, r.choice("abc"), r.choice(["start", *["verify"] * (4 + 6 * (seed % 2)), "resend"]), r.choice("xyzwwwww"), r.choice("xyz")))
    return out


def test_sign_up_rules():
    from tessera.streaming import signup as U

    seen = set()
    for seed in range(60):
        rows = requests_of(seed, 120)
        state, got = {}, []
        for _, now, key, action, code, fresh in rows:
            state[key], answer = U.step(state.get(key), int(now * 1_000_000), action, code, fresh)
            got.append(answer)
        assert got == plain_sign_ups([x[1:] for x in rows])
        seen |= {x.split(":")[0] for x in got}
    assert seen == {"sent", "wait", "too-many", "registered", "none", "expired", "wrong", "locked"}


def test_sign_ups_as_a_table_and_as_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.streaming import signup as U
    from tessera.streaming.drain import drained

    rows = requests_of(7, 400)
    want = dict(enumerate(plain_sign_ups([x[1:] for x in rows])))
    schema = "ident long, at double, email string, action string, code string, fresh string"
    table = spark.createDataFrame([(i, float(at), f" {key.upper()}@x.org", action, code, fresh) for i, at, key, action, code, fresh in rows], schema).withColumn("at", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))
    names = ["email", "ident", "at", "action", "code", "fresh"]
    assert {x.ident: x.answer for x in U.sign_ups(table, *names).collect()} == want
    for lo in range(0, 400, 80):
        table.where(F.col("ident").between(lo, lo + 79)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert {x.ident: x.answer for x in drained(U.sign_up_stream(stream, *names), "append").collect()} == want


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    from tessera.streaming.sinks import append_once, batches

    store = f"{tmp_path}/store"
    assert batches(spark, store) is None
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "id long, key string")
    second = spark.createDataFrame([(6, "b"), (7, "c")], "id long, key string")
    held = lambda: sorted((x.id, x.key, x.batch_no) for x in batches(spark, store).collect())
    append_once(first, 0, store, "key")
    append_once(second, 1, store, "key")
    want = [(1, "a", 0), (3, "b", 0), (4, None, 0), (5, None, 0), (7, "c", 1)]
    assert held() == want
    for number, batch in ((1, second), (0, first), (1, second)):
        append_once(batch, number, store, "key")
        assert held() == want


def test_a_stream_that_is_stopped_and_goes_on(spark, tmp_path):
    """A batch that fails after it was written is run again; keys are stored once over both runs."""
    import pytest

    from tessera.streaming.sinks import append_once, batches, run_to_end

    rows = spark.createDataFrame([(i, f"k{i % 7}") for i in range(40)], "id long, key string")
    for k in range(4):
        rows.where(f"id div 10 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    failed = []

    def write(batch, number):
        append_once(batch, number, f"{tmp_path}/store", "key")
        if number == 2 and not failed:
            failed.append(number)
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run_to_end(stream, "append", f"{tmp_path}/state", write)
    run_to_end(stream, "append", f"{tmp_path}/state", write)
    assert sorted((x.id, x.key) for x in batches(spark, f"{tmp_path}/store").collect()) == [(i, f"k{i}") for i in range(7)]


def test_a_key_in_several_parts_of_a_micro_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.streaming.drain import drained, event_stream

    n = 24_000  # more than one Arrow batch of rows, times not in the order of the rows
    rows = spark.range(n).select((F.col("id") % 2).alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds((F.col("id") * 7919) % n * 60 + 1_700_000_000).alias("ts"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    events = spark.read.parquet(f"{tmp_path}/events.parquet")
    found = drained(S.rate_limit_stream(event_stream(spark, str(tmp_path), 1), "user_id", "event_id", "ts", 2, 86_400), "append")
    assert found.exceptAll(S.rate_limit(events, "user_id", "event_id", "ts", 2, 86_400)).count() == 0
    assert found.count() == n


def test_sends_after_the_moment_do_not_count(spark, tmp_path):
    from tessera.plans.streaming import send_gate

    spark.sql("select * from values (1L, timestamp_ntz'2024-01-20 00:00:00.4'), (2L, timestamp_ntz'2024-01-19 23:59:59.4') t(user_id, ts)").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in send_gate(spark, str(tmp_path)).collect()] == [(2, 599, True)]


def test_addresses_share_a_row_of_the_streams_state(spark, tmp_path):
    """Rows of state and calls a micro-batch are bounded by the slots, not by the addresses; in a shared row a sign-up is gone a
    day after its code expired, while what is registered or waits longer stays."""
    from pyspark.sql import functions as F

    from tessera.streaming import signup as U

    day, names = 86_400, ["email", "ident", "at", "action", "code", "fresh"]
    # Of 59 addresses (one of them null) every third one gives its code; the last one of 60 begins a day later than the others.
    most, every = range(59), range(60)
    steps = [(0, "start", most), (10, "verify", most), (day, "start", [59]), (day + 700, "verify", [1, 59]), (3 * day, "start", every)]
    rows = [(100 * n + k, 1_700_000_000 + at, None if k == 58 else f"a{k}", action, "x" if k % 3 == 0 else "z", "x") for n, (at, action, some) in enumerate(steps) for k in some]
    schema = "ident long, at long, email string, action string, code string, fresh string"
    table = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("at"))
    for n in range(len(steps)):
        table.where(F.col("ident").between(100 * n, 100 * n + 99)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = U.sign_up_stream(stream, *names, slots=4).writeStream.format("memory").queryName("shared_state").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(held) <= 4
    got = {x.ident: (x.address, x.answer) for x in spark.table("shared_state").collect()}
    assert got == {x.ident: (x.address, x.answer) for x in U.sign_ups(table, *names).collect()} and len(got) == len(rows)
    assert (got[301], got[359], got[401], got[403], got[458]) == (("a1", "none"), ("a59", "expired"), ("a1", "sent"), ("a3", "registered"), (None, "sent"))
