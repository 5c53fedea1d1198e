"""Job pages, versions, stage reports, quotas and reuse, over the supplied tables."""

from __future__ import annotations

import base64

from pyspark.sql import functions as F

from tonelake.functions import text
from tonelake.operators import jobs as ops
from tonelake.operators import erasure, limits, upserts
from tonelake.operators.billing import effective_plan
from tonelake.operators.folds import sorted_fold
from tonelake.plans.billing import effective, subscriptions
from tonelake.plans.overview import registrations, tokens
from tonelake.plans.registry import query
from tonelake.plans.role_sql import add_role, with_roles
from tonelake.session import settle
from tonelake.sources.roles import Roles

TENANT = 7
CURSOR_AT, CURSOR_ID = "1998-06-15T00:00:00.000000+00:00", 500
CURSOR = base64.urlsafe_b64encode(f"{CURSOR_AT}|{CURSOR_ID}".encode()).decode()


@query(
    "p1_tenant_jobs",
    with_roles("jobs", f"SELECT job_id, user_id, status, created_at FROM jobs WHERE user_id = {TENANT}"),
)
def tenant_jobs(r: Roles):
    return ops.for_user(r.jobs(), TENANT).select("job_id", "user_id", "status", "created_at")


@query(
    "p3_keyset_before_cursor",
    with_roles(
        "jobs",
        f"""SELECT job_id, user_id, created_at FROM jobs
        WHERE (created_at, job_id) < (TIMESTAMP '1998-06-15', {CURSOR_ID})""",
    ),
)
def keyset_before_cursor(r: Roles):
    return ops.before_cursor(r.jobs(), F.lit(CURSOR)).select("job_id", "user_id", "created_at")


@query(
    "t1_newest_page",
    with_roles(
        "jobs",
        """WITH ahead AS (SELECT job_id, created_at, row_number() OVER w AS place FROM jobs
            WINDOW w AS (ORDER BY created_at DESC, job_id DESC))
        SELECT job_id, created_at, place::INT AS place,
          CASE WHEN place = 20 AND (SELECT count(*) FROM ahead WHERE place <= 21) = 21 THEN
            translate(base64((strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f+00:00') || '|' || job_id)
              ::BLOB), '+/', '-_') END AS next_cursor
        FROM ahead WHERE place <= 20""",
    ),
)
def newest_page(r: Roles):
    return ops.newest_page(r.jobs().select("job_id", "created_at"), 20)


@query(
    "t2_latest_jobs",
    with_roles(
        "jobs",
        """SELECT job_id, created_at, status FROM jobs
        ORDER BY created_at DESC, job_id DESC LIMIT 200""",
    ),
)
def latest_jobs(r: Roles):
    j = r.jobs().select("job_id", "created_at", "status")
    return j.orderBy(F.desc("created_at"), F.desc("job_id")).limit(200)


@query(
    "p4_job_instrument",
    with_roles(
        "jobs",
        "SELECT job_id, json_extract_string(config, '$.instrument') AS instrument FROM jobs",
    ),
)
def job_instrument(r: Roles):
    return ops.job_rows(r.jobs()).select("job_id", "instrument")


@query(
    "p5_job_seconds",
    with_roles(
        "jobs",
        """SELECT job_id, CASE WHEN finished_at IS NOT NULL THEN round_even(
            (epoch_us(finished_at) - epoch_us(submitted_at)) / 1000000.0::DOUBLE, 1) END AS seconds
        FROM jobs""",
    ),
)
def job_seconds(r: Roles):
    return ops.job_rows(r.jobs()).select("job_id", "seconds")


@query(
    "p6_short_messages",
    with_roles(
        "jobs",
        """SELECT job_id, nullif(left(coalesce(error_message, ''), 18), '') AS message FROM jobs""",
    ),
)
def short_messages(r: Roles):
    return r.jobs().select(
        "job_id", text.cut_or_null(F.col("error_message"), 18).alias("message")
    )


@query(
    "p7_error_code_or_unknown",
    with_roles(
        "jobs",
        """SELECT job_id, coalesce(error_code, 'unknown') AS code FROM jobs
        WHERE status = 'failed'""",
    ),
)
def error_code_or_unknown(r: Roles):
    j = r.jobs().where(F.col("status") == "failed")
    return j.select("job_id", F.coalesce("error_code", F.lit("unknown")).alias("code"))


@query(
    "p8_blank_names",
    with_roles(
        "jobs",
        """SELECT job_id, nullif(trim(CASE WHEN job_id % 6 = 0 THEN '   '
            ELSE '  ' || coalesce(name, '') || ' ' END), '') AS name FROM jobs""",
    ),
)
def blank_names(r: Roles):
    raw = F.when(F.col("job_id") % 6 == 0, "   ").otherwise(
        F.concat(F.lit("  "), F.coalesce("name", F.lit("")), F.lit(" "))
    )
    return r.jobs().select("job_id", text.blank_to_null(raw).alias("name"))


@query(
    "p9_quarantined_notes",
    with_roles(
        "annotated",
        """SELECT clip_id, note_idx, concat_ws(',',
            CASE WHEN NOT pitch BETWEEN 38 AND 88 THEN 'pitch' END,
            CASE WHEN NOT velocity BETWEEN 1 AND 120 THEN 'velocity' END,
            CASE WHEN NOT "offset" - onset >= 500 THEN 'length' END) AS reasons
        FROM annotated WHERE NOT (pitch BETWEEN 38 AND 88 AND velocity BETWEEN 1 AND 120
          AND "offset" - onset >= 500)""",
    ),
)
def quarantined_notes(r: Roles):
    rules = {
        "pitch": F.col("pitch").between(38, 88),
        "velocity": F.col("velocity").between(1, 120),
        "length": F.col("offset") - F.col("onset") >= 500,
    }
    _, broken = ops.quarantine(r.annotated(), rules)
    return broken.select("clip_id", "note_idx", F.concat_ws(",", "reasons").alias("reasons"))


# Job rows with a wrong state, capo, hash, size or owner here and there.
add_role(
    "doubtful_jobs",
    "jobs",
    """SELECT job_id, CASE WHEN job_id % 19 = 0 THEN 'done' ELSE status END AS status,
         '{"capo":' || (job_id % 15) || '}' AS config, CASE WHEN job_id % 23 = 0 THEN upper(audio_sha256)
           ELSE audio_sha256 END AS audio_sha256,
         CASE WHEN job_id % 29 > 0 THEN size_bytes END AS size_bytes,
         CASE WHEN job_id % 31 = 0 THEN '../' ELSE '' END || user_id AS user_id FROM jobs""",
)


@query(
    "p9_quarantined_jobs",
    with_roles(
        "doubtful_jobs",
        """SELECT * FROM (SELECT job_id, concat_ws(',', CASE WHEN job_id % 19 = 0 THEN 'status' END,
            CASE WHEN job_id % 15 > 12 THEN 'capo' END,
            CASE WHEN NOT regexp_full_match(audio_sha256, '[0-9a-f]{64}') THEN 'audio_sha256' END,
            CASE WHEN coalesce(size_bytes, 0) <= 0 THEN 'size_bytes' END,
            CASE WHEN NOT regexp_full_match(user_id, '[A-Za-z0-9_-]{1,128}') THEN 'user_id' END) AS reasons
          FROM doubtful_jobs) WHERE reasons <> ''""",
    ),
)
def quarantined_jobs(r: Roles):
    i = F.col("job_id")
    rows = r.jobs().select(
        "job_id",
        F.when(i % 19 == 0, "done").otherwise(F.col("status")).alias("status"),
        F.format_string('{"capo":%d}', i % 15).alias("config"),
        F.when(i % 23 == 0, F.upper("audio_sha256")).otherwise(F.col("audio_sha256")).alias("audio_sha256"),
        F.when(i % 29 > 0, F.col("size_bytes")).alias("size_bytes"),
        F.concat(F.when(i % 31 == 0, "../").otherwise(""), F.col("user_id").cast("string")).alias("user_id"),
    )
    _, broken = ops.quarantine(rows, ops.domain_rules("jobs"))
    return broken.select("job_id", F.concat_ws(",", "reasons").alias("reasons"))


add_role(
    "requests",
    "messages",
    """SELECT event_id AS request_id, user_id, ts AS "at", (['audio/mp4','audio/mpeg','video/avi',
         'audio/wav','audio/flac','text/plain','audio/ogg'])[k % 7 + 1] AS content_type,
         floor(value * 1000000)::BIGINT AS size_bytes, k FROM messages""",
)


def requests(r: Roles):
    types = ["audio/mp4", "audio/mpeg", "video/avi", "audio/wav", "audio/flac", "text/plain", "audio/ogg"]
    return r.messages().select(
        F.col("event_id").alias("request_id"),
        "user_id",
        F.col("ts").alias("at"),
        F.element_at(F.array(*map(F.lit, types)), (F.col("k") % 7 + 1).cast("int")).alias(
            "content_type"
        ),
        F.floor(F.col("value") * 1_000_000).cast("bigint").alias("size_bytes"),
        "k",
    )


@query(
    "p10_upload_gate",
    with_roles(
        "requests users plans",
        """WITH w AS (SELECT r.*, coalesce(p.plan, 'free') AS plan,
            coalesce(u.terms_version = '2026-01', false) AS terms FROM requests r
            LEFT JOIN users u USING (user_id) LEFT JOIN plans p USING (user_id)),
          ranked AS (SELECT *, row_number() OVER (PARTITION BY terms, user_id, epoch_us("at") //
            86400000000 ORDER BY "at", request_id) AS place FROM w)
        SELECT request_id, user_id, CASE WHEN NOT terms THEN 403 WHEN place > 2 THEN 429
          WHEN content_type IN ('video/avi', 'text/plain') THEN 415
          WHEN size_bytes > CASE plan WHEN 'free' THEN 67108864 ELSE 201326592 END THEN 413
          ELSE 201 END::INT AS status FROM ranked""",
    ),
)
def upload_gate(r: Roles):
    asked = requests(r).drop("k")
    return ops.upload_gate(asked, r.users(), effective(r), limit=2, window_s=86_400)


@query(
    "p11_upload_types",
    with_roles(
        "requests",
        """WITH f AS (SELECT request_id, CASE WHEN k % 3 = 0 THEN 'application/octet-stream'
            WHEN k % 5 = 0 THEN NULL ELSE content_type END AS reported,
            'Take.' || k || (['.M4A', '.wav', '.docx', '.ogg', ''])[k % 5 + 1] AS file_name
          FROM requests)
        SELECT request_id, CASE WHEN reported IN ('audio/mp4','audio/aac','audio/mpeg','audio/wav',
            'audio/flac','audio/ogg','audio/x-m4a','audio/x-wav','audio/wave') THEN reported
          ELSE CASE lower(split_part(file_name, '.', -1)) WHEN 'm4a' THEN 'audio/mp4'
            WHEN 'wav' THEN 'audio/wav' WHEN 'ogg' THEN 'audio/ogg' END END AS upload_type FROM f""",
    ),
)
def upload_types(r: Roles):
    reported = F.when(F.col("k") % 3 == 0, "application/octet-stream").when(
        F.col("k") % 5 != 0, F.col("content_type")
    )
    endings = F.array(*map(F.lit, [".M4A", ".wav", ".docx", ".ogg", ""]))
    file_name = F.concat(
        F.lit("Take."), F.col("k").cast("string"), F.element_at(endings, (F.col("k") % 5 + 1).cast("int"))
    )
    return requests(r).select("request_id", text.upload_type(reported, file_name).alias("upload_type"))


add_role(
    "failures",
    "attempts",
    """SELECT job_id, stage, message_id, message_id % 3 + 1 AS attempt, message_id % 4 <> 0
         AS retryable FROM attempts WHERE status = 'failed'""",
)


def failures(r: Roles):
    a = r.stage_attempts().where(F.col("status") == "failed")
    return a.select(
        "job_id",
        "stage",
        "message_id",
        (F.col("message_id") % 3 + 1).alias("attempt"),
        (F.col("message_id") % 4 != 0).alias("retryable"),
    )


@query(
    "p14_failure_classes",
    with_roles(
        "failures",
        """SELECT outcome, coalesce(error_code, '-') AS error_code, count(*) AS failures FROM (
          SELECT CASE WHEN NOT retryable OR attempt >= 3 THEN 'failed' ELSE 'retried' END AS outcome,
            CASE WHEN NOT retryable THEN 'invalid_input' WHEN attempt >= 3 THEN 'stage_failed' END
              AS error_code FROM failures) GROUP BY 1, 2""",
    ),
)
def failure_classes(r: Roles):
    return (
        ops.classify_failures(failures(r))
        .groupBy("outcome", F.coalesce("error_code", F.lit("-")).alias("error_code"))
        .agg(F.count(F.lit(1)).alias("failures"))
    )


@query(
    "f10_retry_delays",
    with_roles(
        "failures",
        """SELECT job_id, stage, message_id, 10.0::DOUBLE * pow(4.0::DOUBLE, attempt - 1)
          AS retry_in_s FROM failures WHERE retryable AND attempt < 3""",
    ),
)
def retry_delays(r: Roles):
    return (
        ops.classify_failures(failures(r))
        .where(F.col("outcome") == "retried")
        .select("job_id", "stage", "message_id", "retry_in_s")
    )


@query(
    "p15_applicable_stages",
    with_roles(
        "jobs",
        """SELECT job_id, coalesce(json_extract_string(config, '$.separation'), 'false') = 'true'
            AS runs_separate,
          json_extract_string(config, '$.instrument') = 'guitar' AS runs_tab FROM jobs""",
    ),
)
def applicable_stages(r: Roles):
    return ops.applicable_stages(r.jobs())


# --- versions ---


@query(
    "w1_latest_ready_version",
    with_roles(
        "versions", "SELECT job_id, max(version) AS version FROM versions WHERE status = 'ready' GROUP BY 1"
    ),
)
def latest_ready_version(r: Roles):
    return ops.latest_ready(r.versions())


@query(
    "w2_version_conflicts",
    with_roles(
        "versions",
        """WITH saves AS (SELECT job_id * 100 + version AS save_id, job_id, version AS base_version,
            CASE WHEN version % 3 = 2 THEN version - 1 END AS from_version FROM versions),
          newest AS (SELECT job_id, max(version) AS latest, arg_max(status, version) AS st
            FROM versions GROUP BY 1)
        SELECT save_id, s.job_id, CASE WHEN o = 'ok' THEN latest + 1 END AS next_version, o AS outcome
        FROM (SELECT s.*, n.latest, CASE WHEN n.st = 'pending' THEN 'still_saving'
            WHEN s.base_version <> n.latest THEN 'newer_version'
            WHEN coalesce(v.status, 'gone') <> 'ready' THEN 'cannot_restore' ELSE 'ok' END AS o
          FROM saves s JOIN newest n USING (job_id) LEFT JOIN versions v
            ON v.job_id = s.job_id AND v.version = coalesce(s.from_version, s.base_version)) s""",
    ),
)
def version_conflicts(r: Roles):
    v = r.versions()
    saves = v.select(
        (F.col("job_id") * 100 + F.col("version")).alias("save_id"),
        "job_id",
        F.col("version").alias("base_version"),
        F.when(F.col("version") % 3 == 2, F.col("version") - 1).alias("from_version"),
    )
    return ops.version_conflicts(v, saves)


@query(
    "j10_renderable_versions",
    with_roles(
        "versions",
        """SELECT p.job_id, p.version, p.base_version,
          CASE WHEN b.status = 'ready' THEN 'render' ELSE 'base_gone' END AS action
        FROM versions p LEFT JOIN versions b ON b.job_id = p.job_id AND b.version = p.base_version
        WHERE p.status = 'pending'""",
    ),
)
def renderable_versions(r: Roles):
    return ops.renderable(r.versions())


# --- stages ---

add_role(
    "runs",
    "attempts",
    """SELECT job_id, stage, arg_max(status, (finished_at, message_id)) AS status,
         arg_max(started_at, (finished_at, message_id)) AS started_at,
         max(finished_at) AS finished_at FROM attempts GROUP BY 1, 2""",
)


def runs(r: Roles):
    """Current state of each (job, stage)."""
    return upserts.last_write_wins(
        r.stage_attempts(),
        ["job_id", "stage"],
        ["finished_at", "message_id"],
        ["status", "started_at", "finished_at"],
    )


@query(
    "j20_stage_states",
    with_roles(
        "jobs runs",
        """WITH spine AS (SELECT unnest(['normalize','separate','transcribe','quantize','notation',
            'tab']) AS stage, unnest(range(0, 6)) AS stage_order)
        SELECT j.job_id, s.stage_order::INT AS stage_order, s.stage,
          CASE WHEN r.status IS NULL THEN 'waiting' WHEN r.status = 'succeeded' THEN 'done'
            ELSE r.status END AS state,
          (epoch_us(finished_at) - epoch_us(started_at)) / 1000000.0::DOUBLE AS seconds
        FROM (SELECT job_id FROM jobs) j CROSS JOIN spine s
          LEFT JOIN runs r ON r.job_id = j.job_id AND r.stage = s.stage""",
    ),
)
def stage_states(r: Roles):
    return ops.stage_states(r.jobs(), runs(r))


@query(
    "t7_stage_order",
    with_roles(
        "runs",
        """SELECT job_id, stage, status FROM runs""",
    ),
)
def stage_order(r: Roles):
    from tonelake.operators.activity import stage_rank

    ordered = runs(r).select("job_id", "stage", "status")
    return ordered.orderBy("job_id", stage_rank(F.col("stage")), "stage")


@query(
    "j7_stage_upsert",
    with_roles(
        "attempts",
        """WITH cur AS (SELECT job_id, stage, arg_max(status, (finished_at, message_id)) AS status,
            arg_max(duration_s, (finished_at, message_id)) AS duration_s
            FROM attempts WHERE message_id % 2 = 0 GROUP BY 1, 2),
          new AS (SELECT job_id, stage, arg_max(status, (finished_at, message_id)) AS status,
            arg_max(duration_s, (finished_at, message_id)) FILTER (status <> 'skipped') AS duration_s
            FROM attempts WHERE message_id % 2 = 1 GROUP BY 1, 2)
        SELECT job_id, stage, coalesce(new.status, cur.status) AS status,
          coalesce(new.duration_s, cur.duration_s) AS duration_s
        FROM cur FULL JOIN new USING (job_id, stage)""",
    ),
)
def stage_upsert(r: Roles):
    a = r.stage_attempts()
    order = ["finished_at", "message_id"]
    current = upserts.last_write_wins(
        a.where(F.col("message_id") % 2 == 0), ["job_id", "stage"], order, ["status", "duration_s"]
    )
    writes = a.where(F.col("message_id") % 2 == 1).withColumn(
        "duration_s", F.when(F.col("status") != "skipped", F.col("duration_s"))
    )
    return upserts.merge(current, writes, ["job_id", "stage"], order)


@query(
    "w25_last_attempts",
    with_roles(
        "attempts",
        """SELECT job_id, stage, arg_max(status, (finished_at, message_id)) AS last_status,
          least(count(*), 3) AS attempts FROM attempts GROUP BY 1, 2""",
    ),
)
def last_attempts(r: Roles):
    return ops.last_attempts(r.stage_attempts())


@query(
    "a12_duration_histogram",
    with_roles(
        "attempts",
        """WITH b AS (SELECT unnest([0.1, 0.5, 1, 2.5, 5, 10, 30, 60, 120, 300, 600, 1e300]::DOUBLE[])
            AS top, unnest(['0.1','0.5','1','2.5','5','10','30','60','120','300','600','+Inf']) AS le)
        SELECT stage, status, le, count(*) FILTER (duration_s <= top) AS observations
        FROM attempts CROSS JOIN b GROUP BY 1, 2, 3""",
    ),
)
def duration_histogram(r: Roles):
    return ops.stage_durations_histogram(r.stage_attempts())


@query(
    "a13_failure_rates",
    with_roles(
        "attempts",
        """SELECT stage, count(*) AS messages,
          count(*) FILTER (status IN ('retried', 'failed')) / count(*)::DOUBLE AS failure_rate
        FROM attempts GROUP BY 1""",
    ),
)
def failure_rates(r: Roles):
    return ops.failure_rates(r.stage_attempts())


_GAPS = """
  WITH per AS (SELECT job_id, stage, stage_rank, min(epoch_us(started_at)) AS s,
      max(epoch_us(finished_at)) AS e, sum((duration_s * 1000000)::BIGINT)::BIGINT AS c
    FROM attempts GROUP BY 1, 2, 3),
  g AS (SELECT *, s - lag(e) OVER (PARTITION BY job_id ORDER BY stage_rank) AS gap FROM per)"""


@query(
    "w8_stage_gaps",
    with_roles(
        "attempts", _GAPS + " SELECT job_id, stage, coalesce(gap, 0) AS gap_us FROM g"
    ),
)
def stage_gaps(r: Roles):
    gaps = ops.stage_gaps(r.stage_attempts())
    return gaps.select("job_id", "stage", F.coalesce("gap_us", F.lit(0)).alias("gap_us"))


@query(
    "a15_stage_costs",
    with_roles(
        "attempts",
        _GAPS
        + """ SELECT stage, count(*) AS jobs, sum(c)::BIGINT AS compute_us,
            sum(e - s - c)::BIGINT AS overhead_us, coalesce(sum(gap), 0)::BIGINT AS gap_us
          FROM g GROUP BY 1""",
    ),
)
def stage_costs(r: Roles):
    """Whole microseconds; decimals where one of the few sums is beyond 64 bits."""
    sums = ["compute_us", "overhead_us", "gap_us"]
    costs = settle(ops.stage_costs(r.stage_attempts()), "stage_costs")
    longest = costs.agg(*[F.max(F.abs(c)) for c in sums]).first()
    if max((n for n in longest if n is not None), default=0) >= 2**63:
        return costs
    return costs.select("stage", "jobs", *[F.col(c).cast("bigint").alias(c) for c in sums])


# --- queue ---

add_role(
    "queue_messages",
    "messages",
    """SELECT (user_id * 1000 + k) AS message_id,
         CASE WHEN k % 6 IN (1, 2) THEN 'ml' ELSE 'cpu' END AS queue,
         CASE WHEN user_id % 4 = 0 THEN 'high' ELSE 'normal' END AS priority,
         arg_max(CASE event_type WHEN 'click' THEN 'ready' WHEN 'view' THEN 'in_flight'
           WHEN 'signup' THEN 'delayed' WHEN 'purchase' THEN 'done' ELSE 'dead' END, event_id) AS state,
         max(ts) AS "at"
       FROM messages GROUP BY user_id, k""",
)


def queue_messages(r: Roles):
    """Newest known state of each queue message."""
    stages = F.array(*[F.lit(s) for s in ops.STAGES])
    event = F.col("event_type")
    moves = r.messages().select(
        (F.col("user_id") * 1000 + F.col("k")).alias("message_id"),
        text.queue_of(F.element_at(stages, (F.col("k") % 6 + 1).cast("int"))).alias("queue"),
        F.when(F.col("user_id") % 4 == 0, "high").otherwise("normal").alias("priority"),
        F.when(event == "click", "ready")
        .when(event == "view", "in_flight")
        .when(event == "signup", "delayed")
        .when(event == "purchase", "done")
        .otherwise("dead")
        .alias("state"),
        F.col("ts").alias("at"),
        "event_id",
    )
    return upserts.last_write_wins(
        moves, ["message_id"], ["event_id"], ["queue", "priority", "state", "at"]
    )


@query(
    "a11_queue_depth",
    with_roles(
        "queue_messages",
        """SELECT q AS queue, p AS priority, s AS state, (SELECT count(*) FROM queue_messages m
            WHERE m.queue = q AND m.priority = p AND m.state = s) AS messages
        FROM (SELECT unnest(['cpu', 'ml']) AS q), (SELECT unnest(['high', 'normal']) AS p),
          (SELECT unnest(['ready', 'in_flight', 'delayed']) AS s)
        UNION ALL SELECT 'all', 'all', 'dead', count(*) FROM queue_messages WHERE state = 'dead'""",
    ),
)
def queue_depth(r: Roles):
    return ops.queue_depth(queue_messages(r))


@query(
    "t8_backlog_order",
    with_roles(
        "queue_messages",
        """SELECT message_id, queue, (CASE priority WHEN 'high' THEN 0 ELSE 1 END)::INT
          AS priority_rank FROM queue_messages WHERE state = 'ready'""",
    ),
)
def backlog_order(r: Roles):
    return ops.backlog_order(queue_messages(r)).select("message_id", "queue", "priority_rank")


# --- quotas and rate limits ---


@query(
    "w5_rate_limit",
    with_roles(
        "messages",
        """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id,
            epoch_us(ts) // 86400000000 ORDER BY ts, event_id) <= 3 AS admitted FROM messages""",
    ),
)
def rate_limit(r: Roles):
    m = r.messages().select("event_id", "user_id", "ts")
    return limits.rate_windows(m, "ts", "event_id", limit=3, window_s=86_400).drop("ts", "rate_window")


# Attempts ten days later than their messages, so that they fall into two months; three users of four
# change their limit on the way: up and down again, to none and back, and down only.
add_role(
    "ledger",
    "messages plans",
    """SELECT *, CASE
          WHEN user_id % 4 = 1 AND d BETWEEN 15 AND 21 THEN 30 WHEN user_id % 4 = 1 AND d > 24 THEN 4
          WHEN user_id % 4 = 2 AND d BETWEEN 3 AND 19 THEN NULL
          WHEN user_id % 4 = 3 AND (d > 22 OR d < 5) THEN 3
          WHEN plan = 'free' THEN 10 WHEN plan = 'pro' THEN 30 END AS month_limit
       FROM (SELECT m.event_id AS entry_id, m.user_id, m.ts + INTERVAL 10 DAY AS "at",
           day(m.ts + INTERVAL 10 DAY) AS d, m.event_type = 'error' AS is_refund,
           coalesce(p.plan, 'free') AS plan
         FROM messages m LEFT JOIN plans p USING (user_id))""",
)
# the counter replayed step by step, independently of the running sums the operator uses
add_role(
    "quota_steps",
    "ledger",
    """SELECT *, strftime("at", '%Y-%m') AS month, row_number() OVER (
         PARTITION BY user_id, strftime("at", '%Y-%m') ORDER BY "at", entry_id) AS i FROM ledger""",
)
_QUOTA = """
  WITH fold AS (
    SELECT user_id, month, i, entry_id, is_refund, month_limit,
      CASE WHEN is_refund THEN -1 WHEN month_limit IS NULL OR 0 < month_limit THEN 1 ELSE 0 END AS c,
      NOT is_refund AND (month_limit IS NULL OR 0 < month_limit) AS admitted
    FROM quota_steps WHERE i = 1
    UNION ALL
    SELECT s.user_id, s.month, s.i, s.entry_id, s.is_refund, s.month_limit,
      CASE WHEN s.is_refund THEN c - 1 WHEN s.month_limit IS NULL OR c < s.month_limit THEN c + 1
        ELSE c END,
      NOT s.is_refund AND (s.month_limit IS NULL OR c < s.month_limit)
    FROM fold f JOIN quota_steps s ON s.user_id = f.user_id AND s.month = f.month AND s.i = f.i + 1)"""


def ledger(r: Roles):
    plan, at = F.coalesce("plan", F.lit("free")), F.expr("ts + INTERVAL 10 DAYS")
    day, kind = F.dayofmonth(at), F.col("user_id") % 4
    limit = (
        F.when((kind == 1) & day.between(15, 21), 30)
        .when((kind == 1) & (day > 24), 4)
        .when((kind == 2) & day.between(3, 19), None)
        .when((kind == 3) & ((day > 22) | (day < 5)), 3)
        .when(plan == "free", 10)
        .when(plan == "pro", 30)
    )
    return (
        r.messages()
        .join(effective_plan(r.users(), effective(r)), "user_id", "left")
        .select(
            F.col("event_id").alias("entry_id"),
            "user_id",
            at.alias("at"),
            (F.col("event_type") == "error").alias("is_refund"),
            limit.alias("month_limit"),
        )
    )


@query(
    "w6_quota_admission",
    with_roles(
        "quota_steps",
        _QUOTA + " SELECT entry_id, user_id, admitted, c::BIGINT AS counted FROM fold",
        recursive=True,
    ),
)
def quota_admission(r: Roles):
    return limits.quota_admission(ledger(r)).select("entry_id", "user_id", "admitted", "counted")


@query(
    "a14_monthly_usage",
    with_roles(
        "quota_steps",
        _QUOTA
        + """ SELECT user_id, month, greatest(0, arg_max(c, i))::BIGINT AS used
          FROM fold GROUP BY 1, 2""",
        recursive=True,
    ),
)
def monthly_usage(r: Roles):
    return limits.monthly_usage(limits.quota_admission(ledger(r)))


# --- folds ---

add_role(
    "metered",
    "messages",
    """SELECT event_id, user_id, CASE WHEN k % 5 > 0 THEN k % 5 END AS meter, CASE WHEN k % 7 > 0 THEN k - 8 END AS step,
         row_number() OVER (PARTITION BY user_id, CASE WHEN k % 5 > 0 THEN k % 5 END ORDER BY ts, event_id) AS i
       FROM messages""",
)


@query(
    "u2_meter_levels",
    with_roles(
        "metered",
        """WITH level AS (
          SELECT event_id, user_id, meter, i, greatest(0, least(20, coalesce(step, 0))) AS level FROM metered WHERE i = 1
          UNION ALL SELECT m.event_id, m.user_id, m.meter, m.i, CASE WHEN m.step IS NULL THEN level
            ELSE greatest(0, least(20, level + m.step)) END
          FROM level l JOIN metered m ON m.user_id = l.user_id AND m.meter IS NOT DISTINCT FROM l.meter
            AND m.i = l.i + 1)
        SELECT event_id, meter, level::BIGINT AS level FROM level""",
        recursive=True,
    ),
)
def meter_levels(r: Roles):
    """A level held between 0 and 20, row by row; meters and steps may be null."""
    k = F.col("k")
    rows = r.messages().select(
        "event_id", "user_id", F.when(k % 5 > 0, k % 5).alias("meter"), "ts", F.when(k % 7 > 0, k - 8).alias("step")
    )

    def step(level, row):
        level = max(0, min(20, (level or 0) + (row[4] or 0)))
        return level, (level,)

    return sorted_fold(rows, ["user_id", "meter"], ["ts", "event_id"], step, "level bigint").select(
        "event_id", "meter", "level"
    )


# --- reuse ---

_KEY = """sha256('{"audio_sha256":"' || audio_sha256 || '","config":{"capo":'
  || json_extract_string(config, '$.capo') || ',"instrument":"'
  || json_extract_string(config, '$.instrument')
  || '","max_duration_s":300.0,"separation":false,"tuning":"standard"},"pipeline_version":"1.4+abc",'
  || '"user_id":"' || user_id || '"}')"""
add_role("keyed_jobs", "jobs", f"SELECT *, {_KEY} AS dedup_key FROM jobs")
add_role(
    "version_files",
    "jobs",
    """SELECT job_id, unnest(CASE WHEN json_extract_string(config, '$.instrument') = 'guitar'
         THEN ['notation/score.musicxml', 'quantize/quantized.mid', 'notation/sync.json',
           'tab/tab.musicxml']
         ELSE ['notation/score.musicxml', 'quantize/quantized.mid', 'notation/sync.json'] END) AS file
       FROM jobs WHERE status = 'succeeded' AND job_id % 9 <> 1""",
)
add_role(
    "listed_files",
    "version_files",
    """SELECT * FROM version_files WHERE NOT (job_id % 8 = 0 AND file = 'notation/sync.json')""",
)


def keyed_jobs(r: Roles):
    j = r.jobs()
    return j.withColumn("dedup_key", ops.dedup_key(j, "1.4+abc"))


def version_files(r: Roles):
    names = ["notation/score.musicxml", "quantize/quantized.mid", "notation/sync.json"]
    guitar = F.get_json_object("config", "$.instrument") == "guitar"
    files = F.when(guitar, F.array(*map(F.lit, [*names, "tab/tab.musicxml"]))).otherwise(
        F.array(*map(F.lit, names))
    )
    done = r.jobs().where((F.col("status") == "succeeded") & (F.col("job_id") % 9 != 1))
    return done.select("job_id", F.explode(files).alias("file"))


def listed_files(r: Roles):
    lost = (F.col("job_id") % 8 == 0) & (F.col("file") == "notation/sync.json")
    return version_files(r).where(~lost)


@query(
    "f24_dedup_keys", with_roles("keyed_jobs", "SELECT job_id, dedup_key FROM keyed_jobs")
)
def dedup_keys(r: Roles):
    return keyed_jobs(r).select("job_id", "dedup_key")


@query(
    "x2_whole_results",
    with_roles(
        "listed_files version_files",
        """SELECT job_id FROM version_files v LEFT JOIN listed_files l USING (job_id, file)
        GROUP BY 1 HAVING count(*) = count(l.job_id)""",
    ),
)
def whole_results(r: Roles):
    return ops.files_present(version_files(r), listed_files(r), ["job_id"])


_REUSE = """
  WITH cache AS (SELECT dedup_key, arg_min(job_id, (finished_at, job_id)) AS cached_job_id
      FROM keyed_jobs WHERE status = 'succeeded' GROUP BY 1),
    whole AS (SELECT job_id FROM version_files v LEFT JOIN
      (SELECT job_id, file, 1 AS here FROM listed_files) l USING (job_id, file)
      GROUP BY 1 HAVING count(*) = count(here))"""


@query(
    "j1_reused_results",
    with_roles(
        "keyed_jobs listed_files version_files",
        _REUSE
        + """ SELECT k.job_id, cached_job_id FROM keyed_jobs k JOIN cache USING (dedup_key)
          WHERE cached_job_id <> k.job_id AND cached_job_id IN (SELECT job_id FROM whole)""",
    ),
)
def reused_results(r: Roles):
    keyed = settle(keyed_jobs(r).select("job_id", "status", "finished_at", "dedup_key"), "keyed")
    return ops.reusable_results(keyed, version_files(r), listed_files(r))


@query(
    "u5_reuse_audit",
    with_roles(
        "keyed_jobs listed_files version_files",
        _REUSE
        + """ SELECT json_extract_string(config, '$.instrument') AS instrument, count(*) AS jobs,
            count(c.cached_job_id) AS would_reuse
          FROM keyed_jobs k LEFT JOIN (SELECT * FROM cache WHERE cached_job_id IN
            (SELECT job_id FROM whole)) c ON c.dedup_key = k.dedup_key
            AND c.cached_job_id <> k.job_id GROUP BY 1""",
    ),
)
def reuse_audit(r: Roles):
    wanted = ["job_id", "user_id", "status", "config", "created_at", "submitted_at", "finished_at"]
    keyed = settle(
        keyed_jobs(r).select(*wanted, "error_code", "error_message", "dedup_key"), "keyed"
    )
    hits = ops.reusable_results(keyed, version_files(r), listed_files(r))
    return (
        ops.job_rows(keyed)
        .join(hits, "job_id", "left")
        .groupBy("instrument")
        .agg(
            F.count(F.lit(1)).alias("jobs"),
            F.count("cached_job_id").alias("would_reuse"),
        )
    )


# --- keyed writes ---


@query(
    "j6_insert_if_absent",
    with_roles(
        "users jobs",
        """SELECT user_id, plan FROM users UNION ALL
        SELECT user_id, arg_min(CASE WHEN job_id % 2 = 0 THEN 'free' ELSE 'trial' END,
          (created_at, job_id)) FROM jobs WHERE user_id NOT IN (SELECT user_id FROM users) GROUP BY 1""",
    ),
)
def insert_if_absent(r: Roles):
    writes = r.jobs().withColumn("plan", F.when(F.col("job_id") % 2 == 0, "free").otherwise("trial"))
    return upserts.insert_if_absent(
        r.users().select("user_id", "plan"), writes, ["user_id"], ["created_at", "job_id"]
    )


@query(
    "j7_token_owners", with_roles("tokens", "SELECT token, user_id, platform FROM tokens")
)
def token_owners(r: Roles):
    return tokens(r)


@query(
    "t4_devices_capped",
    with_roles(
        "tokens",
        """SELECT user_id, token FROM tokens
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY token) <= 2""",
    ),
)
def devices_capped(r: Roles):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("token"))
    return tokens(r).withColumn("place", place).where(F.col("place") <= 2).select("user_id", "token")


add_role(
    "plan_requests",
    "messages",
    """SELECT event_id AS request_id, user_id, ts AS "at", (['free', 'pro', 'unlimited'])[k % 3 + 1]
         AS plan, CASE WHEN k % 4 > 0 THEN 'ticket ' || k END AS note
       FROM messages WHERE event_type = 'purchase'""",
)


def plan_requests(r: Roles):
    plans = F.array(F.lit("free"), F.lit("pro"), F.lit("unlimited"))
    return (
        r.messages()
        .where(F.col("event_type") == "purchase")
        .select(
            F.col("event_id").alias("request_id"),
            "user_id",
            F.col("ts").alias("at"),
            F.element_at(plans, (F.col("k") % 3 + 1).cast("int")).alias("plan"),
            F.when(F.col("k") % 4 > 0, F.format_string("ticket %d", "k")).alias("note"),
        )
    )


@query(
    "j23_plan_change_audit",
    with_roles(
        "plan_requests users",
        """SELECT request_id, p.user_id, "at", coalesce(lag(p.plan) OVER (PARTITION BY p.user_id
            ORDER BY "at", request_id), u.plan, 'free') AS from_plan, p.plan AS to_plan, note
        FROM plan_requests p LEFT JOIN users u ON u.user_id = p.user_id""",
    ),
)
def plan_change_audit(r: Roles):
    return upserts.change_audit(plan_requests(r), r.users())


@query(
    "j23_plans_after_changes",
    with_roles(
        "plan_requests users",
        """SELECT user_id, coalesce(n.plan, u.plan) AS plan FROM users u FULL JOIN
        (SELECT user_id, arg_max(plan, ("at", request_id)) AS plan FROM plan_requests GROUP BY 1) n
        USING (user_id)""",
    ),
)
def plans_after_changes(r: Roles):
    return upserts.merge(
        r.users().select("user_id", "plan"),
        plan_requests(r).select("user_id", "plan", "at", "request_id"),
        ["user_id"],
        ["at", "request_id"],
    )


add_role("result_cache", "keyed_jobs", "SELECT dedup_key, min(job_id) AS job_id FROM keyed_jobs GROUP BY 1")


def result_cache(r: Roles):
    return keyed_jobs(r).groupBy("dedup_key").agg(F.min("job_id").alias("job_id"))


@query(
    "j9_account_erasure",
    with_roles(
        "users jobs runs versions result_cache messages tokens subscriptions plan_requests",
        """WITH gone AS (SELECT DISTINCT user_id FROM messages WHERE event_type = 'error' AND k % 13 < 3),
          lost AS (SELECT job_id FROM jobs WHERE user_id IN (SELECT user_id FROM gone))
        SELECT 'jobs' AS part, count(*) AS kept FROM jobs WHERE user_id NOT IN (SELECT user_id FROM gone)
        UNION ALL SELECT 'users', count(*) FROM users WHERE user_id NOT IN (SELECT user_id FROM gone)
        UNION ALL SELECT 'stage_runs', count(*) FROM runs WHERE job_id NOT IN (SELECT job_id FROM lost)
        UNION ALL SELECT 'score_versions', count(*) FROM versions
          WHERE job_id NOT IN (SELECT job_id FROM lost)
        UNION ALL SELECT 'result_cache', count(*) FROM result_cache
          WHERE job_id NOT IN (SELECT job_id FROM lost)
        UNION ALL SELECT 'subscriptions', count(*) FROM subscriptions
          WHERE user_id NOT IN (SELECT user_id FROM gone)
        UNION ALL SELECT 'admin_actions', count(*) FROM plan_requests
          WHERE user_id NOT IN (SELECT user_id FROM gone)
        UNION ALL SELECT 'push_tokens', count(*) FROM tokens
          WHERE user_id NOT IN (SELECT user_id FROM gone)
        UNION ALL SELECT 'billing_events', count(*) FROM messages
          WHERE user_id NOT IN (SELECT user_id FROM gone)
            AND (user_id + k) NOT IN (SELECT user_id FROM gone)""",
    ),
)
def account_erasure(r: Roles):
    m = r.messages()
    gone = m.where((F.col("event_type") == "error") & (F.col("k") % 13 < 3)).select("user_id")
    tables = {
        "users": r.users(),
        "jobs": r.jobs(),
        "stage_runs": runs(r),
        "score_versions": r.versions(),
        "result_cache": result_cache(r),
        "subscriptions": subscriptions(r),
        "push_tokens": tokens(r),
        "admin_actions": plan_requests(r).withColumnRenamed("user_id", "target_user_id"),
        "billing_events": m.select("event_id", F.array("user_id", F.col("user_id") + F.col("k")).alias("user_ids")),
    }
    out = None
    for part, df in erasure.erase_accounts(tables, gone).items():
        row = df.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(part).alias("part"), "kept")
        out = row if out is None else out.unionByName(row)
    return out


# --- key and text expressions ---


@query(
    "f1_object_keys",
    with_roles(
        "runs jobs",
        """SELECT job_id, stage, 'users/' || user_id || '/jobs/' || job_id || '/' || stage
          || '/manifest.json' AS key FROM runs JOIN jobs USING (job_id)""",
    ),
)
def object_keys(r: Roles):
    key = text.object_key(
        F.col("user_id").cast("string"), F.col("job_id").cast("string"), F.col("stage"),
        F.lit("manifest.json"),
    )
    joined = runs(r).select("job_id", "stage").join(r.jobs().select("job_id", "user_id"), "job_id")
    return joined.select("job_id", "stage", key.alias("key"))


@query(
    "f2_valid_segments",
    """SELECT page_id, regexp_full_match(split_part(url, '/', 4), '[A-Za-z0-9_.-]{1,128}')
         AND split_part(url, '/', 4) NOT IN ('.', '..') AS valid FROM pages""",
)
def valid_segments(r: Roles):
    part = F.coalesce(F.try_element_at(F.split("url", "/"), F.lit(4)), F.lit(""))
    return r.table("pages").select("page_id", text.valid_segment(part).alias("valid"))


@query(
    "f3_export_names",
    """SELECT doc_id, coalesce(nullif(left(trim(regexp_replace(regexp_replace(text,
         '[^\\p{L}\\p{N} _.\\-]+', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '), 80), ''),
         'Untitled score') || '.mid' AS name FROM documents""",
)
def export_names(r: Roles):
    return r.table("documents").select(
        "doc_id", text.export_name(F.col("text"), F.lit("mid")).alias("name")
    )


@query(
    "f4_note_names",
    with_roles(
        "notes",
        """SELECT clip_id, note_idx, (['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])
          [pitch % 12 + 1] || (pitch // 12 - 1) AS note_name FROM notes""",
    ),
)
def note_names(r: Roles):
    return r.notes().select("clip_id", "note_idx", text.note_name(F.col("pitch")).alias("note_name"))


@query(
    "f6_notifications",
    with_roles(
        "jobs",
        """WITH t AS (SELECT *, coalesce(name, CASE json_extract_string(config, '$.instrument')
            WHEN 'guitar' THEN 'Guitar take' ELSE 'Piano take' END) AS take FROM jobs
            WHERE status IN ('succeeded', 'failed'))
        SELECT job_id, CASE status WHEN 'succeeded' THEN 'Your score is ready'
            ELSE 'Couldn''t transcribe “' || take || '”' END AS title,
          CASE status WHEN 'succeeded' THEN '“' || take || '” is transcribed. Tap to see and hear it.'
            ELSE coalesce(error_message, 'Something went wrong.') END AS body FROM t""",
    ),
)
def notifications(r: Roles):
    instrument = F.get_json_object("config", "$.instrument")
    done = r.jobs().where(F.col("status").isin("succeeded", "failed"))
    return done.select(
        "job_id",
        text.notification_title(F.col("status"), F.col("name"), instrument).alias("title"),
        text.notification_body(
            F.col("status"), F.col("name"), instrument, F.col("error_message")
        ).alias("body"),
    )


@query(
    "f7_from_millis",
    with_roles(
        "messages",
        """SELECT event_id, make_timestamp((epoch_us(ts) // 1000) * 1000) AS "at" FROM messages""",
    ),
)
def from_millis(r: Roles):
    return r.messages().select(
        "event_id", text.from_millis(F.expr("unix_micros(ts) div 1000")).alias("at")
    )


@query(
    "f8_f9_week_and_month",
    with_roles(
        "messages",
        """SELECT event_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS monday,
          strftime(ts, '%Y-%m') AS month FROM messages""",
    ),
)
def week_and_month(r: Roles):
    return r.messages().select(
        "event_id",
        F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("monday"),
        text.month_key(F.col("ts")).alias("month"),
    )


@query(
    "f22_same_beats",
    with_roles(
        "messages",
        """SELECT event_id, k * 4 = (k // 3) * 12 AS same FROM messages""",
    ),
)
def same_beats(r: Roles):
    a = F.concat_ws("/", F.col("k").cast("string"), F.lit("12"))
    b = F.concat_ws("/", F.expr("k div 3").cast("string"), F.lit("4"))
    return r.messages().select("event_id", text.same_beats(a, b).alias("same"))


@query(
    "f23_canonical_hash",
    with_roles(
        "jobs",
        """SELECT job_id, sha256('{"instrument":"' || json_extract_string(config, '$.instrument')
          || '","name":' || coalesce('"' || name || '"', 'null') || ',"size_bytes":' || size_bytes
          || '}') AS hash FROM jobs""",
    ),
)
def canonical_hash(r: Roles):
    hashed = text.canonical_hash(
        size_bytes=F.col("size_bytes"),
        name=F.col("name"),
        instrument=F.get_json_object("config", "$.instrument"),
    )
    return r.jobs().select("job_id", hashed.alias("hash"))


@query(
    "f26_pipeline_version",
    with_roles(
        "runs",
        """SELECT job_id, '1.4+' || left(sha256('normalize=' || (job_id % 3) || ';tab='
          || count(*)), 8) AS version FROM runs GROUP BY 1""",
    ),
)
def pipeline_version(r: Roles):
    per_job = runs(r).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    version = text.pipeline_version(
        "1.4",
        [
            ("normalize", (F.col("job_id") % 3).cast("string")),
            ("tab", F.col("n").cast("string")),
        ],
    )
    return per_job.select("job_id", version.alias("version"))


@query(
    "p13_audio_artifacts",
    with_roles(
        "runs",
        """SELECT job_id, stage || '/' || f AS file FROM (SELECT job_id, CASE WHEN stage = 'render'
            THEN 'source' ELSE stage END AS stage, unnest(['audio.flac', 'part/x.wav', 'notes.json'])
            AS f FROM runs)
        WHERE stage = 'source' OR (stage IN ('normalize', 'separate') AND (f LIKE '%.flac'
          OR f LIKE '%.wav'))""",
    ),
)
def audio_artifacts(r: Roles):
    stage = F.when(F.col("stage") == "render", "source").otherwise(F.col("stage"))
    names = F.array(F.lit("audio.flac"), F.lit("part/x.wav"), F.lit("notes.json"))
    files = runs(r).select("job_id", stage.alias("stage"), F.explode(names).alias("name"))
    keyed = files.select("job_id", F.concat_ws("/", "stage", "name").alias("file"))
    return keyed.where(text.is_audio(F.col("file")))
