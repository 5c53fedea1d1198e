"""Overview numbers: accounts, transcriptions, failures, stage times, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.constants import STAGES
from tonelake.operators.quantiles import exact_percentiles

SUBMITTED = "submitted_at IS NOT NULL"


def submitted(jobs: DataFrame) -> DataFrame:
    """Only submitted jobs count as transcriptions."""
    return jobs.where(SUBMITTED)


def totals(jobs: DataFrame, as_of: Column) -> DataFrame:
    recent = F.col("created_at") >= as_of - F.expr("INTERVAL 7 DAYS")
    failed = F.col("status") == "failed"
    return submitted(jobs).agg(
        F.count(F.lit(1)).alias("transcriptions"),
        F.count_if(recent).alias("transcriptions_7d"),
        F.count_if(failed).alias("failed"),
        F.count_if(failed & recent).alias("failed_7d"),
        F.count_distinct("user_id").alias("users_transcribed"),
    )


def active_accounts(accounts: DataFrame, as_of: Column, has_activity: bool = True) -> DataFrame:
    """Accounts active within 1, 7 and 30 days; unknown when no activity feed is configured."""
    if not has_activity:
        nothing = F.lit(None).cast("bigint")
        return accounts.agg(
            F.count(F.lit(1)).alias("accounts"),
            *[F.max(nothing).alias(f"active_{d}d") for d in (1, 7, 30)],
        )
    return accounts.agg(
        F.count(F.lit(1)).alias("accounts"),
        *[
            F.count_if(F.col("last_active") >= as_of - F.expr(f"INTERVAL {d} DAYS")).alias(
                f"active_{d}d"
            )
            for d in (1, 7, 30)
        ],
    )


def per_day(jobs: DataFrame, first_day: Column) -> DataFrame:
    return (
        submitted(jobs)
        .where(F.col("created_at") >= first_day)
        .groupBy(F.to_date("created_at").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("transcriptions"),
            F.count_if(F.col("status") == "failed").alias("failed"),
        )
    )


def signups(accounts: DataFrame) -> DataFrame:
    return accounts.groupBy(F.to_date("joined").alias("day")).agg(
        F.count(F.lit(1)).alias("signups")
    )


def day_spine(spark, as_of: str, days: int) -> DataFrame:
    """Every day of the period, oldest first: at most a year, so it may be broadcast."""
    if not 7 <= days <= 365:
        raise ValueError("days must be between 7 and 365")
    return spark.range(days).select(
        F.date_sub(F.lit(as_of).cast("date"), (F.lit(days - 1) - F.col("id")).cast("int")).alias(
            "day"
        )
    )


def daily_series(
    jobs: DataFrame, accounts: DataFrame, as_of: str, days: int = 30
) -> DataFrame:
    """Transcriptions, failures and sign-ups for each day of the period, with empty days as 0."""
    spine = day_spine(jobs.sparkSession, as_of, days)
    first_day = F.date_sub(F.lit(as_of).cast("date"), days - 1).cast("timestamp")
    return (
        spine.join(per_day(jobs, first_day), "day", "left")
        .join(signups(accounts.where(F.col("joined") >= first_day)), "day", "left")
        .select(
            "day",
            *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("signups", "transcriptions", "failed")],
        )
    )


def stage_rank(stage: Column) -> Column:
    """Running order of a stage; anything else sorts after them."""
    rank = F.lit(99)
    for i, name in reversed(list(enumerate(STAGES))):
        rank = F.when(stage == name, i).otherwise(rank)
    return rank


def stage_times(runs: DataFrame, as_of: Column) -> DataFrame:
    """Runs, median and 95th percentile of successful stage runs of the last 30 days."""
    recent = runs.where(
        (F.col("status") == "succeeded")
        & F.col("duration_s").isNotNull()
        & (F.col("finished_at") >= as_of - F.expr("INTERVAL 30 DAYS"))
    )
    return exact_percentiles(
        recent, ["stage"], "duration_s", {"median_s": 0.5, "p95_s": 0.95}
    ).select(
        "stage",
        "runs",
        F.bround("median_s", 2).alias("median_s"),
        F.bround("p95_s", 2).alias("p95_s"),
        stage_rank(F.col("stage")).alias("stage_order"),
    )


def error_counts(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Failed jobs of the last 30 days by error code, most frequent first."""
    return (
        jobs.where(
            (F.col("status") == "failed")
            & (F.col("created_at") >= as_of - F.expr("INTERVAL 30 DAYS"))
        )
        .groupBy(F.coalesce("error_code", F.lit("unknown")).alias("code"))
        .agg(F.count(F.lit(1)).alias("jobs"))
        .orderBy(F.desc("jobs"), "code")
    )


def per_user(jobs: DataFrame) -> DataFrame:
    return (
        submitted(jobs)
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("transcriptions"),
            F.count_if(F.col("status") == "failed").alias("failed"),
            F.max("created_at").alias("last_transcription"),
        )
    )


def devices_per_user(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("user_id").agg(F.count(F.lit(1)).alias("notification_devices"))


def user_directory(
    accounts: DataFrame, jobs: DataFrame, tokens: DataFrame, users: DataFrame
) -> DataFrame:
    """One row per account, newest first; users of jobs without an account do not appear."""
    known = users.select("user_id", "terms_version", "plan")
    return (
        accounts.join(per_user(jobs), "user_id", "left")
        .join(devices_per_user(tokens), "user_id", "left")
        .join(known, "user_id", "left")
        .select(
            "user_id",
            "email",
            "method",
            "joined",
            "last_active",
            F.col("terms_version").isNotNull().alias("terms_accepted"),
            F.coalesce("transcriptions", F.lit(0)).alias("transcriptions"),
            F.coalesce("failed", F.lit(0)).alias("failed"),
            "last_transcription",
            F.coalesce("notification_devices", F.lit(0)).alias("notification_devices"),
            F.coalesce("plan", F.lit("free")).alias("plan"),
        )
        .orderBy(F.desc("joined"), "user_id")
    )


def operations_snapshot(users: DataFrame, jobs: DataFrame, tokens: DataFrame, as_of: Column):
    """The operations report: every job counts, and the last seven days exclude their first instant."""
    recent = F.col("created_at") > as_of - F.expr("INTERVAL 7 DAYS")
    job_part = jobs.agg(
        F.count_distinct("user_id").alias("users_with_a_transcription"),
        F.count(F.lit(1)).alias("transcriptions"),
        F.count_if(recent).alias("transcriptions_last_7_days"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    user_part = users.agg(F.count(F.lit(1)).alias("users_who_started"))
    token_part = tokens.agg(F.count(F.lit(1)).alias("devices_with_notifications"))
    # three single-row reports become one row: each fills its own columns
    rows = job_part.unionByName(user_part, allowMissingColumns=True).unionByName(
        token_part, allowMissingColumns=True
    )
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def active_weeks(jobs: DataFrame) -> DataFrame:
    """Distinct (user, Monday) with a submitted job."""
    return (
        submitted(jobs)
        .select("user_id", F.to_date(F.date_trunc("week", "created_at")).alias("active_week"))
        .distinct()
    )


def retention_cells(
    accounts: DataFrame, jobs: DataFrame, as_of: str, weeks: int = 8
) -> DataFrame:
    """Per sign-up week and later week: how many of the cohort transcribed something."""
    if not 1 <= weeks <= 52:
        raise ValueError("weeks must be between 1 and 52")
    this_week = F.date_trunc("week", F.lit(as_of).cast("timestamp")).cast("date")
    first_week = F.date_sub(this_week, 7 * (weeks - 1))
    members = accounts.select(
        "user_id", F.to_date(F.date_trunc("week", "joined")).alias("week")
    ).where(F.col("week").between(first_week, this_week))
    seen = active_weeks(jobs.where(F.col("created_at") >= first_week.cast("timestamp")))
    return (
        members.join(seen, "user_id")
        .where(F.col("active_week").between(F.col("week"), this_week))
        .groupBy("week", (F.datediff("active_week", "week") / 7).cast("int").alias("week_offset"))
        .agg(F.count(F.lit(1)).alias("active"))
    )


def retention(accounts: DataFrame, jobs: DataFrame, as_of: str, weeks: int = 8) -> DataFrame:
    """Cohort size and one count per week elapsed; empty cohorts stay, arrays get shorter."""
    spark = accounts.sparkSession
    this_week = F.date_trunc("week", F.lit(as_of).cast("timestamp")).cast("date")
    spine = spark.range(weeks).select(
        F.date_sub(this_week, (F.lit(7) * (F.lit(weeks - 1) - F.col("id"))).cast("int")).alias("week")
    )
    cells = spine.select(
        "week",
        F.explode(
            F.sequence(F.lit(0), (F.datediff(this_week, F.col("week")) / 7).cast("int"))
        ).alias("week_offset"),
    )
    sizes = (
        accounts.select(F.to_date(F.date_trunc("week", "joined")).alias("week"))
        .groupBy("week")
        .agg(F.count(F.lit(1)).alias("size"))
    )
    filled = cells.join(
        retention_cells(accounts, jobs, as_of, weeks), ["week", "week_offset"], "left"
    ).groupBy("week").agg(
        F.transform(
            F.array_sort(
                F.collect_list(F.struct("week_offset", F.coalesce("active", F.lit(0)).alias("n")))
            ),
            lambda cell: cell["n"],
        ).alias("transcribed")
    )
    return filled.join(sizes, "week", "left").select(
        "week", F.coalesce("size", F.lit(0)).alias("size"), "transcribed"
    )
