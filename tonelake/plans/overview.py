"""Overview, user directory, retention and operations queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.operators import activity, upserts
from tonelake.plans.registry import query
from tonelake.plans.role_sql import JOBS_AS_OF, add_role, with_roles
from tonelake.sources.roles import JOBS_AS_OF as AS_OF
from tonelake.sources.roles import Roles, ts

add_role(
    "registrations",
    "messages",
    """SELECT 'ExponentPushToken[' || (user_id % 50) || '-' || (k % 7) || ']' AS token, user_id,
         CASE WHEN k % 2 = 0 THEN 'ios' ELSE 'android' END AS platform, ts AS registered_at,
         event_id
       FROM messages WHERE event_type IN ('signup', 'view')""",
)
add_role(
    "tokens",
    "registrations",
    """SELECT token, arg_max(user_id, event_id) AS user_id, arg_max(platform, event_id) AS platform
       FROM registrations GROUP BY token""",
)


def registrations(r: Roles):
    m = r.messages().where(F.col("event_type").isin("signup", "view"))
    return m.select(
        F.format_string("ExponentPushToken[%d-%d]", F.col("user_id") % 50, F.col("k") % 7).alias(
            "token"
        ),
        "user_id",
        F.when(F.col("k") % 2 == 0, "ios").otherwise("android").alias("platform"),
        F.col("ts").alias("registered_at"),
        "event_id",
    )


def tokens(r: Roles):
    return upserts.last_write_wins(registrations(r), ["token"], ["event_id"], ["user_id", "platform"])


@query(
    "a1_overview_totals",
    with_roles(
        "jobs",
        f"""SELECT count(*) AS transcriptions,
          count(*) FILTER (created_at >= {JOBS_AS_OF} - INTERVAL 7 DAY) AS transcriptions_7d,
          count(*) FILTER (status = 'failed') AS failed,
          count(*) FILTER (status = 'failed' AND created_at >= {JOBS_AS_OF} - INTERVAL 7 DAY)
            AS failed_7d,
          count(DISTINCT user_id) AS users_transcribed
        FROM jobs WHERE submitted_at IS NOT NULL""",
    ),
)
def overview_totals(r: Roles):
    return activity.totals(r.jobs(), ts(AS_OF))


@query(
    "a2_active_accounts",
    with_roles(
        "accounts",
        f"""SELECT count(*) AS accounts,
          count(*) FILTER (last_active >= {JOBS_AS_OF} - INTERVAL 1 DAY) AS active_1d,
          count(*) FILTER (last_active >= {JOBS_AS_OF} - INTERVAL 7 DAY) AS active_7d,
          count(*) FILTER (last_active >= {JOBS_AS_OF} - INTERVAL 30 DAY) AS active_30d
        FROM accounts""",
    ),
)
def active_accounts(r: Roles):
    return activity.active_accounts(r.accounts(), ts(AS_OF))


@query(
    "a3_jobs_per_day",
    with_roles(
        "jobs",
        f"""SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS transcriptions,
          count(*) FILTER (status = 'failed') AS failed
        FROM jobs WHERE submitted_at IS NOT NULL
          AND created_at >= date_trunc('day', {JOBS_AS_OF}) - INTERVAL 364 DAY
        GROUP BY 1""",
    ),
)
def jobs_per_day(r: Roles):
    first = F.date_trunc("day", ts(AS_OF)) - F.expr("INTERVAL 364 DAYS")
    return activity.per_day(r.jobs(), first).withColumn("day", F.col("day").cast("string"))


@query(
    "a4_signups_per_day",
    with_roles(
        "accounts",
        "SELECT strftime(joined, '%Y-%m-%d') AS day, count(*) AS signups FROM accounts GROUP BY 1",
    ),
)
def signups_per_day(r: Roles):
    return activity.signups(r.accounts()).withColumn("day", F.col("day").cast("string"))


_SERIES = f"""
  WITH spine AS (SELECT strftime(unnest(generate_series(
      date_trunc('day', {JOBS_AS_OF}) - INTERVAL 29 DAY, {JOBS_AS_OF}, INTERVAL 1 DAY)),
      '%Y-%m-%d') AS day),
    j AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n,
        count(*) FILTER (status = 'failed') AS f
      FROM jobs WHERE submitted_at IS NOT NULL GROUP BY 1),
    s AS (SELECT strftime(joined, '%Y-%m-%d') AS day, count(*) AS n FROM accounts GROUP BY 1)
  SELECT spine.day, coalesce(s.n, 0) AS signups, coalesce(j.n, 0) AS transcriptions,
    coalesce(j.f, 0) AS failed
  FROM spine LEFT JOIN j USING (day) LEFT JOIN s USING (day)"""


@query("j3_daily_series", with_roles("jobs accounts", _SERIES))
def daily_series(r: Roles):
    series = activity.daily_series(r.jobs(), r.accounts(), AS_OF, 30)
    return series.withColumn("day", F.col("day").cast("string")).orderBy("day")


@query(
    "a5_stage_times",
    with_roles(
        "attempts",
        f"""SELECT stage, count(*) AS runs,
          round_even(quantile_cont(duration_s, 0.5), 2) AS median_s,
          round_even(quantile_cont(duration_s, 0.95), 2) AS p95_s,
          CASE stage WHEN 'normalize' THEN 0 WHEN 'separate' THEN 1 WHEN 'transcribe' THEN 2
            WHEN 'quantize' THEN 3 WHEN 'notation' THEN 4 WHEN 'tab' THEN 5 ELSE 99 END
            AS stage_order
        FROM attempts WHERE status = 'succeeded'
          AND finished_at >= {JOBS_AS_OF} - INTERVAL 30 DAY GROUP BY 1""",
    ),
)
def stage_times(r: Roles):
    return activity.stage_times(r.stage_attempts(), ts(AS_OF)).orderBy("stage_order", "stage")


@query(
    "a6_error_counts",
    with_roles(
        "jobs",
        f"""SELECT coalesce(error_code, 'unknown') AS code, count(*) AS jobs FROM jobs
        WHERE status = 'failed' AND created_at >= {JOBS_AS_OF} - INTERVAL 30 DAY GROUP BY 1""",
    ),
)
def error_counts(r: Roles):
    return activity.error_counts(r.jobs(), ts(AS_OF))


@query(
    "a7_jobs_per_user",
    with_roles(
        "jobs",
        """SELECT user_id, count(*) AS transcriptions,
          count(*) FILTER (status = 'failed') AS failed, max(created_at) AS last_transcription
        FROM jobs WHERE submitted_at IS NOT NULL GROUP BY 1""",
    ),
)
def jobs_per_user(r: Roles):
    return activity.per_user(r.jobs())


@query(
    "a8_devices_per_user",
    with_roles("tokens", "SELECT user_id, count(*) AS notification_devices FROM tokens GROUP BY 1"),
)
def devices_per_user(r: Roles):
    return activity.devices_per_user(tokens(r))


@query(
    "a9_operations_snapshot",
    with_roles(
        "users jobs tokens",
        f"""SELECT (SELECT count(*) FROM users) AS users_who_started,
          count(DISTINCT user_id) AS users_with_a_transcription, count(*) AS transcriptions,
          count(*) FILTER (created_at > {JOBS_AS_OF} - INTERVAL 7 DAY) AS transcriptions_last_7_days,
          count(*) FILTER (status = 'failed') AS failed,
          (SELECT count(*) FROM tokens) AS devices_with_notifications FROM jobs""",
    ),
)
def operations_snapshot(r: Roles):
    return activity.operations_snapshot(r.users(), r.jobs(), tokens(r), ts(AS_OF))


_RETENTION_BASE = f"""
  WITH tw AS (SELECT date_trunc('week', {JOBS_AS_OF})::DATE AS this_week),
  spine AS (SELECT (this_week - (7 * i)::INT)::DATE AS week, i AS age FROM tw, range(0, 26) g(i)),
  cells AS (SELECT week, age, unnest(range(0, age + 1)) AS week_offset FROM spine),
  members AS (SELECT user_id, date_trunc('week', joined)::DATE AS week FROM accounts),
  seen AS (SELECT DISTINCT user_id, date_trunc('week', created_at)::DATE AS active_week FROM jobs
    WHERE submitted_at IS NOT NULL),
  hits AS (SELECT week, (active_week - week) // 7 AS week_offset, count(*) AS n
    FROM members JOIN seen USING (user_id) GROUP BY 1, 2)"""


@query(
    "a10_retention_matrix",
    with_roles(
        "accounts jobs",
        _RETENTION_BASE
        + """ SELECT strftime(week, '%Y-%m-%d') AS week,
            (SELECT count(*) FROM members m WHERE m.week = c.week) AS size,
            string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY week_offset) AS transcribed
          FROM cells c LEFT JOIN hits USING (week, week_offset) GROUP BY c.week""",
    ),
)
def retention_matrix(r: Roles):
    matrix = activity.retention(r.accounts(), r.jobs(), AS_OF, 26)
    return matrix.select(
        F.col("week").cast("string").alias("week"),
        "size",
        F.concat_ws(",", F.transform("transcribed", lambda n: n.cast("string"))).alias(
            "transcribed"
        ),
    )


@query(
    "j4_retention_membership",
    with_roles(
        "accounts jobs",
        _RETENTION_BASE
        + """ SELECT strftime(c.week, '%Y-%m-%d') AS week, c.week_offset::INT AS week_offset,
            n AS active
          FROM cells c JOIN hits h ON c.week = h.week AND c.week_offset = h.week_offset""",
    ),
)
def retention_membership(r: Roles):
    cells = activity.retention_cells(r.accounts(), r.jobs(), AS_OF, 26)
    return cells.withColumn("week", F.col("week").cast("string"))


@query(
    "x1_active_user_weeks",
    with_roles(
        "jobs",
        """SELECT DISTINCT user_id, strftime(date_trunc('week', created_at), '%Y-%m-%d')
          AS active_week FROM jobs WHERE submitted_at IS NOT NULL""",
    ),
)
def active_user_weeks(r: Roles):
    weeks = activity.active_weeks(r.jobs())
    return weeks.withColumn("active_week", F.col("active_week").cast("string"))


@query(
    "j2_user_directory",
    with_roles(
        "accounts jobs tokens users",
        """WITH j AS (SELECT user_id, count(*) AS n, count(*) FILTER (status = 'failed') AS f,
            max(created_at) AS last FROM jobs WHERE submitted_at IS NOT NULL GROUP BY 1),
          d AS (SELECT user_id, count(*) AS n FROM tokens GROUP BY 1)
        SELECT a.user_id, email, method, joined, last_active,
          u.terms_version IS NOT NULL AS terms_accepted, coalesce(j.n, 0) AS transcriptions,
          coalesce(j.f, 0) AS failed, j.last AS last_transcription,
          coalesce(d.n, 0) AS notification_devices, coalesce(u.plan, 'free') AS plan
        FROM accounts a LEFT JOIN j USING (user_id) LEFT JOIN d USING (user_id)
          LEFT JOIN users u USING (user_id)""",
    ),
)
def user_directory(r: Roles):
    return activity.user_directory(r.accounts(), r.jobs(), tokens(r), r.users())


@query(
    "t6_accounts_by_joined",
    with_roles("accounts", "SELECT user_id, joined, method FROM accounts"),
)
def accounts_by_joined(r: Roles):
    return r.accounts().select("user_id", "joined", "method").orderBy(F.desc("joined"), "user_id")


@query(
    "p2_windowed_failures",
    with_roles(
        "jobs",
        f"""SELECT job_id, user_id, status FROM jobs WHERE submitted_at IS NOT NULL
          AND status = 'failed' AND created_at >= {JOBS_AS_OF} - INTERVAL 90 DAY""",
    ),
)
def windowed_failures(r: Roles):
    recent = F.col("created_at") >= ts(AS_OF) - F.expr("INTERVAL 90 DAYS")
    return (
        activity.submitted(r.jobs())
        .where((F.col("status") == "failed") & recent)
        .select("job_id", "user_id", "status")
    )
