"""Streams over several files and restarts, against the batch form of the same work."""

import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tonelake.operators import limits
from tonelake.streaming import jobs


@pytest.fixture()
def pieces(spark, roles, tmp_path):
    """The event stream cut into three files that arrive in time order."""
    events = roles.messages().cache()
    edges = [0, 300, 700, 10**9]
    folder = tmp_path / "arriving"

    def arrive(i):
        part = events.where(F.col("event_id").between(edges[i], edges[i + 1] - 1))
        part.coalesce(1).write.mode("append").parquet(str(folder))

    def stream():
        return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return events, arrive, stream, str(tmp_path / "state")


def ledger(messages):
    return messages.select(
        F.col("event_id").alias("entry_id"),
        "user_id",
        F.col("ts").alias("at"),
        (F.col("event_type") == "error").alias("is_refund"),
        F.when(F.col("user_id") % 2 == 0, 5).alias("month_limit"),
    )


def test_quota_is_carried_over_batches_and_restarts(spark, pieces):
    events, arrive, stream, root = pieces
    for i in range(3):  # each run starts anew from the checkpoint
        arrive(i)
        found = jobs.quota_admission(ledger(stream()), root)
    got = {r.entry_id: (r.admitted, r.counted) for r in found.collect()}
    expected = limits.quota_admission(ledger(events)).collect()
    assert got == {r.entry_id: (r.admitted, r.counted) for r in expected}


def test_a_rerun_adds_nothing(spark, pieces):
    _, arrive, stream, root = pieces
    arrive(0)
    once = jobs.quota_admission(ledger(stream()), root).count()
    assert jobs.quota_admission(ledger(stream()), root).count() == once


def test_events_are_handled_once(spark, pieces):
    events, arrive, stream, root = pieces
    users = spark.createDataFrame([(i,) for i in range(15)], "user_id bigint")

    def deliveries(df):
        return df.select(
            F.col("event_id").cast("string").alias("event_id"),
            F.lit("RENEWAL").alias("type"),
            F.lit("PRODUCTION").alias("environment"),
            F.array("user_id").alias("user_ids"),
            F.explode(F.sequence(F.lit(1), F.lit(2))).alias("delivery"),
        ).withColumn("provider_down", (F.col("delivery") == 1) & (F.col("event_id") % 2 == 0))

    for i in range(2):
        arrive(i)
        log = jobs.ingest_events(deliveries(stream()), users, users.limit(0), "production", root)
    rows = log.read(spark)
    assert rows.count() == rows.select("event_id").distinct().count() == 700
    assert {r.outcome for r in rows.collect()} == {"synced"}


def test_rate_windows_over_several_batches(spark, pieces):
    events, arrive, stream, root = pieces
    for i in range(3):
        arrive(i)
        found = jobs.rate_windows(stream().select("user_id", "ts"), 1, "1 hour", 2 * 86_400, root)
    expected = events.groupBy("user_id", F.window("ts", "1 hour").start.alias("w")).count()
    assert {(r.user_id, r.window_start, r.attempts) for r in found.collect()} == {
        tuple(r) for r in expected.collect()
    }


def moves(df):
    event = F.col("event_type")
    return df.select(
        "event_id",
        "ts",
        (F.col("user_id") * 10 + F.col("k") % 10).alias("job_id"),
        F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("k") % 2 + 1).cast("int")).alias("stage"),
        F.when(event == "purchase", "done").when(event == "error", "dead").otherwise(event).alias("state"),
    )


def test_stage_states_ignore_messages_after_the_end(spark, pieces):
    events, arrive, stream, root = pieces
    for i in range(3):
        arrive(i)
        now, gauge = jobs.stage_states(moves(stream()), root)
    over, expected = set(), {}
    for r in moves(events).orderBy("event_id").collect():
        if r.job_id in over:
            continue
        expected[r.job_id, r.stage] = r.state
        if r.state in jobs.TERMINAL:
            over.add(r.job_id)
    assert {(r.job_id, r.stage): r.state for r in now.collect()} == expected
    assert gauge.select("batch_id").distinct().count() == 3


def test_stalls_are_reported_once(spark, pieces):
    events, arrive, stream, root = pieces
    def watched(df):
        return df.select((F.col("user_id") * 10 + F.col("k") % 10).alias("message_id"), "ts")

    for i in range(3):
        arrive(i)
        found = jobs.stalled_messages(watched(stream()), 86_400, 3600, root)
    beats = {}
    for r in watched(events).orderBy("ts").collect():
        beats.setdefault(r.message_id, []).append(r.ts)
    silences = {
        m: [a for a, b in zip(at, at[1:], strict=False) if (b - a).total_seconds() > 86_400]
        for m, at in beats.items()
    }
    # A message has three attempts; what comes after the last is not told.
    closed = {(m, a) for m, at in silences.items() for a in at[:3]}
    got = [(r.message_id, r.last_seen) for r in found.collect()]
    assert len(got) == len(set(got))
    assert closed <= set(got)
    assert {(m, at) for m, at in got if (m, at) not in closed} <= {(m, at[-1]) for m, at in beats.items()}


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (1, 2, 0)])
def test_any_order_of_batches_gives_one_result(spark, pieces, order):
    """Rate windows, stage counters and silences do not depend on when rows came."""
    events, arrive, stream, root = pieces
    def watched(df):
        return df.select((F.col("user_id") * 10 + F.col("k") % 10).alias("message_id"), "ts")

    def handled(df):
        return df.select("ts", F.col("event_type").alias("stage"), F.lit("x").alias("outcome"), F.col("k").cast("double").alias("duration_s"))

    for i in order:
        arrive(i)
        rates = jobs.rate_windows(stream().select("user_id", "ts"), 1, "1 hour", 3600, root)
        counters = jobs.stage_counters(handled(stream()), "1 day", 3600, (5.0, 30.0), root)
        silences = jobs.stalled_messages(watched(stream()), 86_400, 3600, root)
    expected = events.groupBy("user_id", F.window("ts", "1 hour").start.alias("w")).count()
    assert {(r.user_id, r.window_start, r.attempts) for r in rates.collect()} == {tuple(r) for r in expected.collect()}
    whole = handled(events).groupBy(F.window("ts", "1 day").start.alias("w"), "stage", "outcome").agg(
        F.count("*"), F.count_if(F.col("duration_s") <= 5), F.count_if(F.col("duration_s") <= 30)
    )
    assert {tuple(r) for r in counters.select("window_start", "stage", "outcome", "n", "le_0", "le_1").collect()} == {
        tuple(r) for r in whole.collect()
    }
    beats, want = {}, set()
    for r in watched(events).orderBy("ts").collect():
        beats.setdefault(r.message_id, []).append(r.ts)
    now = max(at[-1] for at in beats.values()) - timedelta(hours=1)
    for m, at in beats.items():
        lost = [a for a, b in zip(at, [*at[1:], now], strict=True) if (b - a).total_seconds() > 86_400]
        want |= {(m, a, i, "exhausted" if i == 3 else "stalled") for i, a in enumerate(lost[:3], start=1)}
    assert {tuple(r) for r in silences.collect()} == want


def test_rows_that_come_to_a_closed_window_are_told(spark, pieces):
    _, arrive, stream, root = pieces
    for i in (1, 2, 0):
        arrive(i)
        found = jobs.window_counts(stream(), {}, {"n": F.count(F.lit(1))}, "1 hour", 3600, root)
    row = found.agg(F.sum("n"), F.sum("corrections")).first()
    assert row[0] == 1000 and 290 <= row[1] <= 300


def test_webhooks_land_once_with_all_their_fields(spark, tmp_path):
    folder, root = tmp_path / "hooks", str(tmp_path / "state")

    def arrive(*bodies):
        spark.createDataFrame([(b,) for b in bodies], "body string").coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema("body string").option("maxFilesPerTrigger", 1).parquet(str(folder))
        return jobs.land_webhooks(stream, root)

    one = '{"event": {"id": "e1", "type": "RENEWAL", "app_user_id": "u1"}}'
    arrive(one, one, "not json", '{"event": {"type": "TEST"}}')
    # A later event has fields of kinds nobody listed; an earlier one is sent again.
    landed, refused = arrive(one, '{"event": {"id": "e2", "app_user_id": "u2", "offer": {"price": 4.5, "codes": [1, 2]}}, "api": 2}')
    rows = {r.event_id: r for r in landed.read(spark).selectExpr(
        "event_id", "type", "user_ids", "variant_get(document, '$.event.offer.codes[1]', 'int') as code",
        "variant_get(document, '$.api', 'int') as api").collect()}
    assert set(rows) == {"e1", "e2"} and landed.read(spark).count() == 2
    assert rows["e1"].type == "RENEWAL" and rows["e1"].user_ids == ["u1"] and rows["e1"].code is None
    assert (rows["e2"].code, rows["e2"].api, rows["e2"].type) == (2, 2, None)
    assert sorted(r.body for r in refused.read(spark).collect()) == ["not json", '{"event": {"type": "TEST"}}']


def test_late_rows_are_set_aside(spark, pieces):
    _, arrive, stream, root = pieces
    for i in (1, 2, 0):
        arrive(i)
        on_time, late = jobs.split_late(stream(), 3600, root)
    assert on_time.read(spark).count() == 700
    assert late.read(spark).count() == 300


def test_shared_folder_is_the_clusters(spark):
    from tonelake.session import shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert os.path.isdir(shared_dir(spark).removeprefix("file://"))


def test_nothing_is_said_after_the_last_attempt(spark, roles):
    rows = entry.queries()["r6_stalled_messages"](spark, roles.sf_dir).groupBy("message_id").count()
    assert rows.where("count > 3").count() == 0
