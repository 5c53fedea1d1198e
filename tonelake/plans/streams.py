"""The streams run over the supplied tables until everything available is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.operators import jobs as job_ops
from tonelake.plans.billing import allowed, subscriptions, webhook_bodies
from tonelake.plans.overview import tokens
from tonelake.plans.registry import query
from tonelake.plans.role_sql import add_role, with_roles
from tonelake.session import scratch_path
from tonelake.sources import records
from tonelake.sources.roles import Roles
from tonelake.streaming import jobs


class StreamRoles(Roles):
    """The same roles, with tables read as streams of files."""

    def table(self, name: str):
        # a pattern, because a file stream takes a folder or a pattern, and a table may be one file
        pattern = f"{self.sf_dir}/{name}[.]parquet"
        return self.spark.readStream.schema(self.schema(name)).parquet(pattern)


def live(r: Roles) -> StreamRoles:
    return StreamRoles(r.spark, r.sf_dir)


def deliveries(r: Roles):
    """Store events, every other one delivered twice; some first deliveries find no provider."""
    landed = records.webhooks(webhook_bodies(r))
    number = F.substring_index("event_id", "-", -1).cast("bigint")
    return landed.select(
        "event_id",
        "type",
        "environment",
        F.col("user_ids").cast("array<bigint>").alias("user_ids"),
        F.explode(F.sequence(F.lit(1), (F.lit(1) + number % 2).cast("int"))).alias("delivery"),
        number.alias("number"),
    ).withColumn("provider_down", (F.col("delivery") == 1) & (F.col("number") % 6 == 1))


_OUTCOMES = """WITH n AS (SELECT event_id, type, environment, u, environment = 'PRODUCTION'
    OR (environment = 'SANDBOX' AND u IN (SELECT user_id FROM users
      WHERE plan_changed_by IS NOT NULL)) AS counts, u IN (SELECT user_id FROM users) AS known
  FROM hooks LEFT JOIN (SELECT event_id, unnest(ids) AS u FROM hooks) USING (event_id)),
  g AS (SELECT event_id, type, environment, count(u) AS ids,
    count(*) FILTER (u IS NOT NULL AND counts) AS counted,
    count(*) FILTER (counts AND known) AS known FROM n GROUP BY ALL)
  SELECT event_id, CASE WHEN type = 'TEST' THEN 'test'
    WHEN environment = 'LOCAL' OR (ids > 0 AND counted = 0) THEN 'other_environment'
    WHEN known = 0 THEN 'unknown_user' ELSE 'synced' END AS outcome FROM g"""


@query("r1_ingested_events", with_roles("hooks users", _OUTCOMES))
def ingested_events(r: Roles):
    root = scratch_path(r.spark, "r1")
    log = jobs.ingest_events(deliveries(live(r)), r.users(), allowed(r), "production", root)
    return log.read(r.spark).select("event_id", "outcome")


@query(
    "r2_synced_subscriptions",
    with_roles(
        "subscriptions hooks users",
        """SELECT user_id, product_id FROM subscriptions WHERE user_id IN (SELECT user_id FROM users)
          AND user_id IN (SELECT unnest(ids) FROM hooks)""",
    ),
)
def synced_subscriptions(r: Roles):
    root = scratch_path(r.spark, "r2")
    found = jobs.sync_touched_users(deliveries(live(r)), r.users(), subscriptions(r), root)
    return found.select("user_id", "product_id")


@query(
    "s4_streamed_payloads",
    with_roles(
        "hooks",
        """SELECT event_id, type, environment, event_at, array_to_string(ids, ',') AS user_ids, 'extra' AS unlisted
        FROM hooks""",
    ),
)
def streamed_payloads(r: Roles):
    landed, _ = jobs.land_webhooks(webhook_bodies(live(r)), scratch_path(r.spark, "s4"))
    return landed.read(r.spark).select(
        "event_id",
        "type",
        "environment",
        "event_at",
        F.array_join("user_ids", ",").alias("user_ids"),
        F.expr("variant_get(document, '$.event.unlisted_field', 'string')").alias("unlisted"),
    )


@query(
    "r3_rate_windows",
    with_roles(
        "messages",
        """SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS attempts,
          count(*) > 1 AS over_limit FROM messages GROUP BY 1, 2""",
    ),
)
def rate_windows(r: Roles):
    attempts = live(r).messages().select("user_id", "ts")
    return jobs.rate_windows(attempts, 1, "1 hour", 3600, scratch_path(r.spark, "r3"))


add_role(
    "quota_ledger",
    "messages",
    """SELECT event_id AS entry_id, user_id, event_type = 'error' AS is_refund,
         CASE WHEN user_id % 5 = 1 AND day(ts) > 12 THEN 3
           ELSE (ARRAY[10, 30, NULL])[user_id % 3 + 1] END AS month_limit, strftime(ts, '%Y-%m') AS month,
         row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS i
       FROM messages""",
)


@query(
    "r4_streamed_quota",
    with_roles(
        "quota_ledger",
        """WITH fold AS (
          SELECT user_id, month, i, entry_id, CASE WHEN is_refund THEN -1 ELSE 1 END AS c,
            NOT is_refund AS admitted FROM quota_ledger WHERE i = 1
          UNION ALL SELECT s.user_id, s.month, s.i, s.entry_id, CASE WHEN s.is_refund THEN c - 1
              WHEN s.month_limit IS NULL OR c < s.month_limit THEN c + 1 ELSE c END,
            NOT s.is_refund AND (s.month_limit IS NULL OR c < s.month_limit)
          FROM fold f JOIN quota_ledger s
            ON s.user_id = f.user_id AND s.month = f.month AND s.i = f.i + 1)
        SELECT entry_id, user_id, admitted, c::BIGINT AS counted FROM fold""",
        recursive=True,
    ),
)
def streamed_quota(r: Roles):
    fallen = (F.col("user_id") % 5 == 1) & (F.dayofmonth("ts") > 12)
    limit = F.when(fallen, 3).when(F.col("user_id") % 3 == 0, 10).when(F.col("user_id") % 3 == 1, 30)
    ledger = live(r).messages().select(
        F.col("event_id").alias("entry_id"),
        "user_id",
        F.col("ts").alias("at"),
        (F.col("event_type") == "error").alias("is_refund"),
        limit.alias("month_limit"),
    )
    decided = jobs.quota_admission(ledger, scratch_path(r.spark, "r4"))
    return decided.select("entry_id", "user_id", "admitted", "counted")


add_role(
    "stage_moves",
    "messages",
    """SELECT event_id, ts, user_id * 10 + k // 10 AS job_id,
         (['normalize','separate','transcribe','quantize','notation','tab'])[k % 6 + 1] AS stage,
         CASE event_type WHEN 'click' THEN 'ready' WHEN 'view' THEN 'in_flight' WHEN 'signup' THEN
           'delayed' WHEN 'purchase' THEN 'done' ELSE 'dead' END AS state FROM messages""",
)
add_role(
    "stage_now",
    "stage_moves",
    """WITH o AS (SELECT job_id, min(event_id) FILTER (state IN ('done', 'dead')) AS over_at
           FROM stage_moves GROUP BY 1)
       SELECT job_id, stage, arg_max(state, event_id) AS state FROM stage_moves JOIN o USING (job_id)
       WHERE over_at IS NULL OR event_id <= over_at GROUP BY 1, 2""",
)


def stage_moves(r: Roles):
    stages = F.array(*[F.lit(s) for s in job_ops.STAGES])
    event = F.col("event_type")
    return r.messages().select(
        "event_id",
        "ts",
        (F.col("user_id") * 10 + F.expr("k div 10")).alias("job_id"),
        F.element_at(stages, (F.col("k") % 6 + 1).cast("int")).alias("stage"),
        F.when(event == "click", "ready")
        .when(event == "view", "in_flight")
        .when(event == "signup", "delayed")
        .when(event == "purchase", "done")
        .otherwise("dead")
        .alias("state"),
    )


@query("r5_stage_states", with_roles("stage_now", "SELECT job_id, stage, state FROM stage_now"))
def stage_states(r: Roles):
    now, _ = jobs.stage_states(stage_moves(live(r)), scratch_path(r.spark, "r5"))
    return now.select("job_id", "stage", "state")


@query(
    "r8_state_gauge",
    with_roles("stage_now", "SELECT state, count(*) AS stages FROM stage_now GROUP BY 1"),
)
def state_gauge(r: Roles):
    """The gauge after the last batch."""
    _, gauge = jobs.stage_states(stage_moves(live(r)), scratch_path(r.spark, "r8"))
    last = gauge.agg(F.max("batch_id").alias("batch_id"))
    return gauge.join(last, "batch_id", "left_semi").select("state", "stages")


@query(
    "r6_stalled_messages",
    with_roles(
        "messages",
        """WITH b AS (SELECT user_id * 10 + k // 10 AS message_id, ts, (SELECT max(ts) FROM messages)
             - INTERVAL 1 HOUR AS over FROM messages),
           g AS (SELECT message_id, ts, coalesce(lead(ts) OVER (PARTITION BY message_id ORDER BY ts),
             over) AS heard FROM b),
           lost AS (SELECT message_id, ts AS last_seen, row_number() OVER (PARTITION BY message_id
             ORDER BY ts)::INT AS attempt FROM g WHERE epoch_us(heard) - epoch_us(ts) > 86400000000)
         SELECT *, CASE WHEN attempt = 3 THEN 'exhausted' ELSE 'stalled' END AS outcome FROM lost
         WHERE attempt <= 3""",
    ),
)
def stalled_messages(r: Roles):
    beats = live(r).messages().select((F.col("user_id") * 10 + F.expr("k div 10")).alias("message_id"), "ts")
    return jobs.stalled_messages(beats, 86_400, 3600, scratch_path(r.spark, "r6"))


def failed_attempts(r: Roles):
    m = r.messages().where(F.col("event_type") == "error")
    return m.select(
        F.col("event_id").alias("message_id"),
        "ts",
        (F.col("k") % 3 + 1).alias("attempt"),
        (F.col("k") % 4 != 0).alias("retryable"),
    )


@query(
    "r7_retry_ledger",
    with_roles(
        "messages",
        """SELECT event_id AS message_id, k % 3 + 1 AS attempt, k % 3 + 2 AS next_attempt,
          ts + to_seconds((10 * pow(4, k % 3))::BIGINT) AS due_at FROM messages
        WHERE event_type = 'error' AND k % 4 <> 0 AND k % 3 < 2""",
    ),
)
def retry_ledger(r: Roles):
    retried, _ = jobs.retry_ledger(failed_attempts(live(r)), scratch_path(r.spark, "r7"))
    return retried.select("message_id", "attempt", "next_attempt", "due_at")


@query(
    "r7_dead_letters",
    with_roles(
        "messages",
        """SELECT CASE WHEN k % 4 = 0 THEN 'invalid_input' ELSE 'stage_failed' END AS error_code,
          count(*) AS letters FROM messages
        WHERE event_type = 'error' AND (k % 4 = 0 OR k % 3 = 2) GROUP BY 1""",
    ),
)
def dead_letters(r: Roles):
    _, dead = jobs.retry_ledger(failed_attempts(live(r)), scratch_path(r.spark, "r7d"))
    return dead.groupBy("error_code").agg(F.count(F.lit(1)).alias("letters"))


@query(
    "r9_stage_counters",
    with_roles(
        "attempts",
        """SELECT time_bucket(INTERVAL 7 DAY, finished_at, TIMESTAMP '1970-01-01') AS window_start,
          stage, status AS outcome, count(*) AS n, count(*) FILTER (duration_s <= 5) AS le_0,
          count(*) FILTER (duration_s <= 30) AS le_1 FROM attempts GROUP BY 1, 2, 3""",
    ),
)
def stage_counters(r: Roles):
    handled = live(r).stage_attempts().select(
        F.col("finished_at").alias("ts"), "stage", F.col("status").alias("outcome"), "duration_s"
    )
    return jobs.stage_counters(handled, "7 days", 86_400, (5.0, 30.0), scratch_path(r.spark, "r9"))


@query(
    "r10_notification_targets",
    with_roles(
        "jobs tokens",
        """WITH t AS (SELECT * FROM tokens QUALIFY row_number() OVER (PARTITION BY user_id
            ORDER BY token) <= 3)
        SELECT job_id, token, CASE status WHEN 'succeeded' THEN 'Your score is ready' ELSE
          'Couldn''t transcribe “' || coalesce(name, CASE json_extract_string(config, '$.instrument')
            WHEN 'guitar' THEN 'Guitar take' ELSE 'Piano take' END) || '”' END AS title
        FROM jobs JOIN t USING (user_id) WHERE status IN ('succeeded', 'failed')""",
    ),
)
def notification_targets(r: Roles):
    targets, _ = jobs.notification_fan_out(
        live(r).jobs(), tokens(r), F.lit(False), scratch_path(r.spark, "r10"), max_devices=3
    )
    return targets.select("job_id", "token", "title")


@query(
    "r10_tokens_kept",
    with_roles(
        "jobs tokens",
        """SELECT token, user_id FROM tokens WHERE NOT (token LIKE '%-3]' AND user_id IN
          (SELECT user_id FROM jobs WHERE status IN ('succeeded', 'failed')))""",
    ),
)
def tokens_kept(r: Roles):
    gone = F.col("token").endswith("-3]")
    _, kept = jobs.notification_fan_out(live(r).jobs(), tokens(r), gone, scratch_path(r.spark, "r10k"))
    return kept.select("token", "user_id")


@query(
    "r11_on_time_events",
    with_roles("messages", "SELECT event_id, ts FROM messages"),
)
def on_time_events(r: Roles):
    on_time, _ = jobs.split_late(live(r).messages(), 3600, scratch_path(r.spark, "r11"))
    return on_time.read(r.spark).select("event_id", "ts")
