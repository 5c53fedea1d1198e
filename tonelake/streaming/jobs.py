"""The service's event streams: webhooks, rate windows, quotas, stage states, stalls, notifications.

Every job takes a streaming DataFrame and a folder, runs what is available and leaves a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions.constants import MAX_ATTEMPTS, MAX_DEVICES
from tonelake.operators import billing, jobs, limits
from tonelake.operators.upserts import first_write_wins, last_write_wins
from tonelake.sources import records
from tonelake.streaming.log import BatchLog, run_available

TERMINAL = ("done", "dead")


# --- store events ---


def ingest_events(
    events: DataFrame, users: DataFrame, allowed: DataFrame, environment: str, root: str
) -> BatchLog:
    """Webhook deliveries handled once per event: (event_id, outcome, user_ids).

    `events` has (event_id, type, environment, user_ids, delivery, provider_down). A repeat of a
    handled event is a no-op. A delivery that found the provider down is not recorded as handled,
    so its redelivery is. Repeats inside a batch are folded to the first that can be handled.
    """
    log = BatchLog(f"{root}/events", "event_id string, outcome string, user_ids array<bigint>")
    columns = ["type", "environment", "user_ids"]

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        usable = batch.where(~F.col("provider_down"))
        fresh = first_write_wins(usable, ["event_id"], ["delivery"], columns)
        handled = log.read(batch.sparkSession, before=batch_id).select("event_id")
        new = fresh.join(handled, "event_id", "left_anti")
        outcomes = billing.event_outcomes(new, users, allowed, environment)
        log.write(
            new.join(outcomes, "event_id").select("event_id", "outcome", "user_ids"), batch_id
        )

    run_available(events, on_batch, f"{root}/events-checkpoint")
    return log


def land_webhooks(bodies: DataFrame, root: str) -> tuple[BatchLog, BatchLog]:
    """Store events as they were sent: typed columns and the whole document, and bodies that are none.

    `bodies` has (body). A document is kept as a variant, so fields that nobody has listed yet can be
    asked for later, whatever their type; no column changes when the store adds one. The first landing
    of an event id stands. A body that is no JSON, or has no id, goes to the second table as text.
    """
    typed = "event_id string, type string, environment string, store string, product_id string, event_at timestamp"
    landed = BatchLog(f"{root}/webhooks", f"{typed}, user_ids array<string>, document variant")
    refused = BatchLog(f"{root}/refused", "body string")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        rows = records.webhooks(batch.select("body")).withColumn("document", F.try_parse_json("payload"))
        usable = F.col("event_id").isNotNull() & F.col("document").isNotNull()
        refused.write(rows.where(~usable).select(F.col("payload").alias("body")), batch_id)
        columns = [c for c in rows.columns if c not in ("event_id", "payload", "document")]
        # A variant is no grouping value, so the text is folded and parsed again.
        first = first_write_wins(rows.where(usable), ["event_id"], ["payload"], [*columns, "payload"])
        before = landed.read(batch.sparkSession, before=batch_id).select("event_id")
        new = first.join(before, "event_id", "left_anti")
        landed.write(new.select("event_id", *columns, F.parse_json("payload").alias("document")), batch_id)

    run_available(bodies, on_batch, f"{root}/webhooks-checkpoint")
    return landed, refused


def sync_touched_users(
    events: DataFrame, users: DataFrame, snapshot: DataFrame, root: str
) -> DataFrame:
    """Subscriptions of every user an event named, re-read from the provider's snapshot.

    An event only says who changed. What changed is read afresh, so events that come twice or in
    the wrong order end in the same rows. A user synced to nothing is kept as touched with none.
    """
    log = BatchLog(f"{root}/synced", "user_id bigint, product_id string")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        touched = (
            batch.select(F.explode("user_ids").alias("user_id"))
            .distinct()
            .join(users.select("user_id"), "user_id", "left_semi")
        )
        rows = touched.join(snapshot.select("user_id", "product_id"), "user_id", "left")
        log.write(rows, batch_id)

    run_available(events, on_batch, f"{root}/synced-checkpoint")
    rows = log.read(events.sparkSession)
    newest = rows.groupBy("user_id").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest, ["user_id", "batch_id"], "left_semi").where(
        F.col("product_id").isNotNull()
    )


# --- rate windows and counters ---


def window_counts(
    events: DataFrame, keys: dict[str, str], counts: dict[str, Column], width: str, delay_s: int, root: str
) -> DataFrame:
    """(window_start, keys, counts, corrections): counts of rows per fixed window of `ts`, late rows included.

    `keys` are columns with their types. Each batch writes what it adds to each window it touches;
    sums of these parts are the counts, so any cutting of the rows into batches, in any order, gives
    the same ones, and a batch costs what its own rows cost. A row whose window ended more than
    `delay_s` before the newest row of earlier batches is late: it is counted like the others, and
    `corrections` says how many rows came to a window after it was closed. A row without a time has
    no window.
    """
    names = ["window_start", *keys]
    typed = "".join(f", {c} {kind}" for c, kind in keys.items()) + "".join(f", {n} bigint" for n in counts)
    parts = BatchLog(f"{root}/parts", f"window_start timestamp{typed}, corrections bigint")
    seen = BatchLog(f"{root}/seen", "newest timestamp")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        newest = seen.read(batch.sparkSession, before=batch_id).agg(F.max("newest")).first()[0]
        closed = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay_s} SECONDS")
        windowed = batch.where("ts is not null").withColumn("w", F.window("ts", width))
        windowed = windowed.withColumn("window_start", F.col("w.start"))
        late = F.count_if(F.coalesce(F.col("w.end") <= closed, F.lit(False)))
        found = windowed.groupBy(*names).agg(*[c.alias(n) for n, c in counts.items()], late.alias("corrections"))
        parts.write(found.select(*names, *counts, "corrections"), batch_id)
        seen.write(batch.agg(F.max("ts").alias("newest")), batch_id)

    run_available(events, on_batch, f"{root}/checkpoint")
    rows = parts.read(events.sparkSession)
    return rows.groupBy(*names).agg(*[F.sum(n).alias(n) for n in (*counts, "corrections")])


def rate_windows(attempts: DataFrame, limit: int, width: str, delay_s: int, root: str) -> DataFrame:
    """Attempts per (user, fixed window), every attempt counted, and whether it went over."""
    counts = {"attempts": F.count(F.lit(1))}
    found = window_counts(attempts, {"user_id": "bigint"}, counts, width, delay_s, f"{root}/rates")
    return found.select("user_id", "window_start", "attempts", (F.col("attempts") > limit).alias("over_limit"))


def stage_counters(
    handled: DataFrame, width: str, delay_s: int, bounds: tuple[float, ...], root: str
) -> DataFrame:
    """Handled stage messages per window, stage and outcome, with cumulative duration buckets."""
    counts = {"n": F.count(F.lit(1))}
    counts |= {f"le_{i}": F.count_if(F.col("duration_s") <= b) for i, b in enumerate(bounds)}
    keys = {"stage": "string", "outcome": "string"}
    return window_counts(handled, keys, counts, width, delay_s, f"{root}/counters").drop("corrections")


def split_late(events: DataFrame, delay_s: int, root: str) -> tuple[BatchLog, BatchLog]:
    """On-time rows and, aside, the rows that came more than `delay_s` behind the newest seen.

    `events` has (event_id, ts). The newest time of earlier batches is what a row is late against.
    """
    schema = "event_id bigint, ts timestamp"
    on_time, late = BatchLog(f"{root}/on-time", schema), BatchLog(f"{root}/late", schema)
    seen = BatchLog(f"{root}/seen", "newest timestamp")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = seen.read(spark, before=batch_id).agg(F.max("newest")).first()[0]
        limit = F.lit(newest) - F.expr(f"INTERVAL {delay_s} SECONDS")
        is_late = F.lit(False) if newest is None else F.col("ts") < limit
        rows = batch.select("event_id", "ts")
        on_time.write(rows.where(~is_late), batch_id)
        late.write(rows.where(is_late), batch_id)
        seen.write(batch.agg(F.max("ts").alias("newest")), batch_id)

    run_available(events, on_batch, f"{root}/late-checkpoint")
    return on_time, late


# --- quotas ---

_DECIDED = "entry_id bigint, user_id bigint, month string, admitted boolean, counted bigint"


def quota_admission(ledger: DataFrame, root: str) -> DataFrame:
    """Monthly quotas with refunds, one counter per (user, month) carried between batches.

    `ledger` has (entry_id, user_id, at, is_refund, month_limit). A refused attempt is not counted.
    Each batch goes on from the counters the batches before it left, with the running sums of the
    batch operator, so a very busy user in one batch is spread over tasks.
    """
    decided = BatchLog(f"{root}/quota", _DECIDED)
    counters = BatchLog(f"{root}/counters", "user_id bigint, month string, counted bigint")
    keys = ["user_id", "month"]

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        left = last_write_wins(
            counters.read(spark, before=batch_id), keys, ["batch_id"], ["counted"]
        )
        rows = limits.quota_admission(batch, left)
        decided.write(rows.select("entry_id", *keys, "admitted", "counted"), batch_id)
        counters.write(last_write_wins(rows, keys, ["at", "entry_id"], ["counted"]), batch_id)

    run_available(ledger, on_batch, f"{root}/quota-checkpoint")
    return decided.read(ledger.sparkSession).drop("batch_id")


# --- stage states ---


def stage_states(events: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Current state per (job, stage), and the number of stages in each state after each batch.

    `events` has (event_id, ts, job_id, stage, state). Once a job is over, later events for it are
    stale messages and change nothing.
    """
    moves = BatchLog(
        f"{root}/stage-moves",
        "job_id bigint, stage string, state string, ts timestamp, event_id bigint",
    )
    over = BatchLog(f"{root}/jobs-over", "job_id bigint, over_at bigint")
    gauge = BatchLog(f"{root}/gauge", "state string, stages bigint")
    keys, values = ["job_id", "stage"], ["state", "ts"]

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        finished = over.read(spark, before=batch_id).select("job_id")
        live = batch.join(finished, "job_id", "left_anti")
        ends = live.where(F.col("state").isin(*TERMINAL)).groupBy("job_id").agg(
            F.min("event_id").alias("over_at")
        )
        kept = (
            live.join(ends, "job_id", "left")
            .where(F.col("over_at").isNull() | (F.col("event_id") <= F.col("over_at")))
        )
        newest = last_write_wins(kept, keys, ["event_id"], [*values, "event_id"])
        moves.write(newest.select(*keys, *values, "event_id"), batch_id)
        over.write(ends, batch_id)
        now = last_write_wins(moves.read(spark), keys, ["event_id"], values)
        gauge.write(now.groupBy("state").agg(F.count(F.lit(1)).alias("stages")), batch_id)

    run_available(events, on_batch, f"{root}/stages-checkpoint")
    spark = events.sparkSession
    return (
        last_write_wins(moves.read(spark), keys, ["event_id"], values),
        gauge.read(spark),
    )


def stalled_messages(heartbeats: DataFrame, timeout_s: int, delay_s: int, root: str) -> DataFrame:
    """Messages whose worker went quiet for longer than the timeout, an attempt lost each time.

    `heartbeats` has (message_id, ts). Each batch keeps the first and last sign of life of a message
    within each stretch of time as long as the timeout; inside one nobody can be quiet for too long, so
    these are all that silences depend on. First and last ones of several batches merge, in whatever
    order rows come: a late sign of life takes back the silence it falls into. A message's last silence
    counts once the newest time, less `delay_s`, is past its end. After MAX_ATTEMPTS a message is exhausted, and
    nothing more is said of it.
    """
    beats = BatchLog(f"{root}/beats", "message_id bigint, stretch bigint, first timestamp, last timestamp")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        stretch = F.expr(f"unix_seconds(ts) div {timeout_s}").alias("stretch")
        ends = (F.min("ts").alias("first"), F.max("ts").alias("last"))
        beats.write(batch.where("ts is not null").groupBy("message_id", stretch).agg(*ends), batch_id)

    run_available(heartbeats, on_batch, f"{root}/beats-checkpoint")
    known = beats.read(heartbeats.sparkSession)
    merged = known.groupBy("message_id", "stretch").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    newest = F.lit(known.agg(F.max("last")).first()[0]).cast("timestamp")
    order = Window.partitionBy("message_id").orderBy("stretch")
    heard = F.coalesce(F.lead("first").over(order), newest - F.expr(f"INTERVAL {delay_s} SECONDS"))
    quiet = F.unix_micros(F.col("heard")) - F.unix_micros("last") > timeout_s * 1_000_000
    lost = merged.withColumn("heard", heard).where(quiet)
    attempt = F.row_number().over(order).cast("int")
    return lost.withColumn("attempt", attempt).where(F.col("attempt") <= MAX_ATTEMPTS).select(
        "message_id",
        F.col("last").alias("last_seen"),
        "attempt",
        F.when(F.col("attempt") >= MAX_ATTEMPTS, "exhausted").otherwise("stalled").alias("outcome"),
    )


def retry_ledger(failures: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Failed attempts with the next attempt's due time, and those that are dead letters.

    `failures` has (message_id, ts, attempt, retryable).
    """
    log = BatchLog(
        f"{root}/retries",
        "message_id bigint, ts timestamp, attempt bigint, outcome string, error_code string, "
        "next_attempt bigint, due_at timestamp",
    )

    def ledger(df: DataFrame) -> DataFrame:
        due = F.timestamp_micros(
            F.unix_micros("ts") + (F.col("retry_in_s") * 1_000_000).cast("bigint")
        )
        return jobs.classify_failures(df).select(
            "message_id",
            "ts",
            "attempt",
            "outcome",
            "error_code",
            F.when(F.col("outcome") == "retried", F.col("attempt") + 1).alias("next_attempt"),
            due.alias("due_at"),
        )

    run_available(ledger(failures), lambda df, i: log.write(df, i), f"{root}/retries-checkpoint")
    rows = log.read(failures.sparkSession).drop("batch_id")
    return rows.where(F.col("outcome") == "retried"), rows.where(F.col("outcome") == "failed")


def notification_fan_out(
    finished: DataFrame, tokens: DataFrame, gone: Column, root: str, max_devices: int = MAX_DEVICES
) -> tuple[DataFrame, DataFrame]:
    """One row per device for each finished job, and the tokens still good afterwards.

    `gone` says which targets the push service would report as no longer registered.
    """
    log = BatchLog(f"{root}/targets", "job_id bigint, user_id bigint, token string, title string")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        targets = jobs.notification_targets(batch, tokens, max_devices)
        log.write(targets.select("job_id", "user_id", "token", "title"), batch_id)

    run_available(finished, on_batch, f"{root}/targets-checkpoint")
    targets = log.read(tokens.sparkSession).drop("batch_id")
    dropped = targets.where(gone).select("token").distinct()
    return targets, tokens.join(dropped, "token", "left_anti")
