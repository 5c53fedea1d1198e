"""Job pages, versions, stage states, reuse of earlier results and the upload gate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions import constants as k
from tonelake.functions import text
from tonelake.functions.constants import (
    MAX_ATTEMPTS,
    MAX_DEVICES,
    PLAN_LIMITS,
    STAGE_SECONDS_BUCKETS,
    STAGES,
    TERMS_VERSION,
)
from tonelake.operators.billing import effective_plan
from tonelake.operators.limits import rate_windows
from tonelake.operators.upserts import first_write_wins


def for_user(df: DataFrame, user_id) -> DataFrame:
    """The tenant filter every query for a user goes through."""
    if user_id is None:
        raise ValueError("a user id is required")
    return df.where(F.col("user_id") == F.lit(user_id))


def cursor(created_at: Column, job_id: Column) -> Column:
    """Opaque page cursor: base64url of `iso time|id`."""
    iso = F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    raw = F.base64(F.encode(F.concat_ws("|", iso, job_id.cast("string")), "utf-8"))
    return F.translate(raw, "+/", "-_")


def parse_cursor(value: Column) -> Column:
    """struct(created_at, job_id), or null when the cursor is not one of ours."""
    plain = F.try_to_binary(F.translate(value, "-_", "+/"), F.lit("base64"))
    parts = F.split(plain.cast("string"), r"\|")
    created = F.try_to_timestamp(parts[0])
    job_id = F.try_element_at(parts, F.lit(2)).try_cast("bigint")
    whole = (F.size(parts) == 2) & created.isNotNull() & job_id.isNotNull()
    return F.when(whole, F.struct(created.alias("created_at"), job_id.alias("job_id")))


def before_cursor(jobs: DataFrame, value: Column) -> DataFrame:
    """Rows that come after the cursor in a newest-first listing."""
    at = parse_cursor(value)
    return jobs.where(
        at.isNotNull() & (F.struct("created_at", "job_id") < at)
    )


def newest_page(jobs: DataFrame, limit: int) -> DataFrame:
    """The newest `limit` jobs and the cursor of the next page, found by reading one row more."""
    ahead = jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit + 1)
    newest_first = Window.orderBy(F.desc("created_at"), F.desc("job_id"))  # limit + 1 rows at most
    placed = ahead.withColumn("place", F.row_number().over(newest_first)).withColumn(
        "more", F.lead("job_id").over(newest_first).isNotNull()
    )
    next_cursor = F.when(
        (F.col("place") == limit) & F.col("more"), cursor(F.col("created_at"), F.col("job_id"))
    )
    return placed.where(F.col("place") <= limit).select(
        *jobs.columns, "place", next_cursor.alias("next_cursor")
    )


def job_rows(jobs: DataFrame) -> DataFrame:
    """The support view of jobs: instrument, seconds from submit to finish, short error."""
    micros = F.expr("unix_micros(finished_at) - unix_micros(submitted_at)")
    return jobs.select(
        "job_id",
        "user_id",
        "status",
        "created_at",
        F.get_json_object("config", "$.instrument").alias("instrument"),
        F.when(F.col("finished_at").isNotNull(), F.bround(micros / 1_000_000, 1)).alias("seconds"),
        "error_code",
        text.cut_or_null(F.col("error_message"), 300).alias("error_message"),
    )


def quarantine(
    df: DataFrame, rules: Mapping[str, Column]
) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every rule, and the others with the names of the rules they break."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )
    marked = df.withColumn("reasons", broken)
    return (
        marked.where(F.size("reasons") == 0).drop("reasons"),
        marked.where(F.size("reasons") > 0),
    )


def _whole_match(column: str, pattern: str) -> Column:
    return F.col(column).rlike(pattern)


def domain_rules(table: str) -> dict[str, Column]:
    """What every row of a table must satisfy, by name; for `quarantine`. A null satisfies nothing.

    jobs: status, capo (from config), audio_sha256, size_bytes, owner and key, which become parts of
    object keys. attempts: stage, state, attempt. push_tokens: token, platform.
    """
    rules = {
        "jobs": {
            "status": F.col("status").isin(*k.JOB_STATES),
            "capo": F.get_json_object("config", "$.capo").try_cast("int").between(0, k.MAX_CAPO),
            "audio_sha256": _whole_match("audio_sha256", r"^[0-9a-f]{64}\z"),
            "size_bytes": F.col("size_bytes") > 0,
            "user_id": text.valid_user_id(F.col("user_id").cast("string")),
            "job_id": text.valid_segment(F.col("job_id").cast("string")),
        },
        "attempts": {
            "stage": F.col("stage").isin(*STAGES),
            "state": F.col("status").isin(*k.STAGE_STATES),
            "attempt": F.col("attempt") >= 1,
        },
        "push_tokens": {
            "token": _whole_match("token", k.PUSH_TOKEN) & (F.length("token") <= 255),
            "platform": F.col("platform").isin(*k.PLATFORMS),
        },
    }
    return rules[table]


# --- versions ---


def latest_ready(versions: DataFrame) -> DataFrame:
    """The newest rendered version of each job."""
    return (
        versions.where(F.col("status") == "ready")
        .groupBy("job_id")
        .agg(F.max("version").alias("version"))
    )


def version_conflicts(versions: DataFrame, saves: DataFrame) -> DataFrame:
    """What saving on `base_version` leads to: the next number, or why it is refused."""
    newest = versions.groupBy("job_id").agg(
        F.max("version").alias("latest"),
        F.max_by("status", "version").alias("latest_status"),
    )
    source = versions.select(
        "job_id", F.col("version").alias("source_version"), F.col("status").alias("source_status")
    )
    wanted = saves.withColumn("source_version", F.coalesce("from_version", "base_version"))
    reason = (
        F.when(F.col("latest_status") == "pending", "still_saving")
        .when(F.col("base_version") != F.col("latest"), "newer_version")
        .when(F.coalesce("source_status", F.lit("gone")) != "ready", "cannot_restore")
    )
    return (
        wanted.join(newest, "job_id")
        .join(source, ["job_id", "source_version"], "left")
        .select(
            "save_id",
            "job_id",
            F.when(reason.isNull(), F.col("latest") + 1).alias("next_version"),
            F.coalesce(reason, F.lit("ok")).alias("outcome"),
        )
    )


def renderable(versions: DataFrame) -> DataFrame:
    """Pending versions with the state of the version they are based on."""
    base = versions.select(
        "job_id", F.col("version").alias("base_version"), F.col("status").alias("base_status")
    )
    pending = versions.where(F.col("status") == "pending")
    return pending.join(base, ["job_id", "base_version"], "left").select(
        "job_id",
        "version",
        "base_version",
        F.when(F.col("base_status") == "ready", "render").otherwise("base_gone").alias("action"),
    )


# --- stages ---


def stage_states(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Every stage of every job with the state shown for it; unreached stages are waiting."""
    spine = F.array(
        *[F.struct(F.lit(i).alias("stage_order"), F.lit(s).alias("stage")) for i, s in enumerate(STAGES)]
    )
    all_stages = jobs.select("job_id", F.inline(spine))
    seconds = F.expr("(unix_micros(finished_at) - unix_micros(started_at)) / 1000000")
    state = (
        F.when(F.col("status").isNull() | (F.col("status") == "queued"), "waiting")
        .when(F.col("status").isin("succeeded", "cached"), "done")
        .otherwise(F.col("status"))
    )
    return all_stages.join(runs, ["job_id", "stage"], "left").select(
        "job_id", "stage_order", "stage", state.alias("state"), seconds.alias("seconds")
    )


def last_attempts(attempts: DataFrame) -> DataFrame:
    """Per (job, stage): the newest attempt and how many count towards the limit."""
    newest = F.max_by(
        F.struct("status", "finished_at"), F.struct("finished_at", "message_id")
    )
    return (
        attempts.groupBy("job_id", "stage")
        .agg(newest.alias("last"), F.count(F.lit(1)).alias("attempts"))
        .select(
            "job_id",
            "stage",
            F.col("last.status").alias("last_status"),
            F.least("attempts", F.lit(MAX_ATTEMPTS)).alias("attempts"),
        )
    )


def classify_failures(failures: DataFrame) -> DataFrame:
    """Retry or give up, and the error code a dead job gets."""
    dead = ~F.col("retryable") | (F.col("attempt") >= MAX_ATTEMPTS)
    return failures.select(
        "*",
        F.when(dead, "failed").otherwise("retried").alias("outcome"),
        F.when(dead, F.when(F.col("retryable"), "stage_failed").otherwise("invalid_input")).alias(
            "error_code"
        ),
        F.when(~dead, text.retry_delay_s(F.col("attempt"))).alias("retry_in_s"),
    )


def applicable_stages(jobs: DataFrame) -> DataFrame:
    """Whether each optional stage runs for a job's configuration."""
    instrument = F.get_json_object("config", "$.instrument")
    separation = F.coalesce(F.get_json_object("config", "$.separation"), F.lit("false"))
    return jobs.select(
        "job_id",
        (separation == "true").alias("runs_separate"),
        (instrument == "guitar").alias("runs_tab"),
    )


def stage_durations_histogram(attempts: DataFrame) -> DataFrame:
    """Cumulative duration buckets per stage and outcome, in one pass over the attempts."""
    bounds = [*STAGE_SECONDS_BUCKETS, float("inf")]
    counts = [F.count_if(F.col("duration_s") <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(bounds)]
    cells = F.array(
        *[
            F.struct(
                F.lit("+Inf" if b == float("inf") else f"{b:g}").alias("le"),
                F.col(f"b{i}").alias("observations"),
            )
            for i, b in enumerate(bounds)
        ]
    )
    return (
        attempts.groupBy("stage", "status").agg(*counts).select("stage", "status", F.inline(cells))
    )


def failure_rates(attempts: DataFrame) -> DataFrame:
    bad = F.count_if(F.col("status").isin("retried", "failed"))
    return attempts.groupBy("stage").agg(
        F.count(F.lit(1)).alias("messages"),
        (bad / F.count(F.lit(1))).alias("failure_rate"),
    )


def stage_gaps(attempts: DataFrame) -> DataFrame:
    """Per (job, stage): compute, time on the message, and the wait since the stage before.

    Attempts are folded to one row per (job, stage) first, so at most one row per stage is
    ordered for a job.
    """
    micros = F.col("duration_s") * 1_000_000
    per_stage = attempts.groupBy("job_id", "stage", "stage_rank").agg(
        F.min(F.expr("unix_micros(started_at)")).alias("start_us"),
        F.max(F.expr("unix_micros(finished_at)")).alias("end_us"),
        F.sum(micros.cast("bigint")).alias("compute_us"),
    )
    order = Window.partitionBy("job_id").orderBy("stage_rank")
    return per_stage.withColumn("gap_us", F.col("start_us") - F.lag("end_us").over(order))


def stage_costs(attempts: DataFrame) -> DataFrame:
    """Where the time of each stage goes: computing, overhead around it, waiting before it.

    The sums are decimals: microseconds of some ten million jobs with years between their attempts
    go beyond 64 bits.
    """
    spent = F.col("end_us") - F.col("start_us")

    def total(micros: Column) -> Column:
        return F.sum(micros.cast("decimal(20,0)"))

    return (
        stage_gaps(attempts)
        .groupBy("stage")
        .agg(
            F.count(F.lit(1)).alias("jobs"),
            total(F.col("compute_us")).alias("compute_us"),
            total(spent - F.col("compute_us")).alias("overhead_us"),
            F.coalesce(total(F.col("gap_us")), F.lit(0)).alias("gap_us"),
        )
    )


# --- queue ---


def queue_depth(messages: DataFrame) -> DataFrame:
    """Messages per queue, priority and state; every combination is listed."""
    spark = messages.sparkSession
    spine = spark.createDataFrame(
        [(q, p, s) for q in ("cpu", "ml") for p in ("high", "normal") for s in ("ready", "in_flight", "delayed")],
        "queue string, priority string, state string",
    )
    counts = messages.groupBy("queue", "priority", "state").agg(F.count(F.lit(1)).alias("messages"))
    return F.broadcast(spine).join(counts, ["queue", "priority", "state"], "left").select(
        "queue", "priority", "state", F.coalesce("messages", F.lit(0)).alias("messages")
    ).unionByName(
        messages.where(F.col("state") == "dead")
        .agg(F.count(F.lit(1)).alias("messages"))
        .select(
            F.lit("all").alias("queue"), F.lit("all").alias("priority"),
            F.lit("dead").alias("state"), "messages",
        )
    )


def backlog_order(messages: DataFrame) -> DataFrame:
    """Waiting messages in the order they would be taken: priority, then queue, then age."""
    return (
        messages.where(F.col("state") == "ready")
        .withColumn("priority_rank", F.when(F.col("priority") == "high", 0).otherwise(1))
        .orderBy("priority_rank", "queue", "at", "message_id")
    )


def notification_targets(
    finished: DataFrame, tokens: DataFrame, max_devices: int = MAX_DEVICES
) -> DataFrame:
    """One row per device to tell about each finished job, `max_devices` per user at most."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("token"))
    devices = tokens.withColumn("place", place).where(F.col("place") <= max_devices)
    instrument = F.get_json_object("config", "$.instrument")
    told = finished.where(F.col("status").isin("succeeded", "failed")).select(
        "job_id",
        "user_id",
        text.notification_title(F.col("status"), F.col("name"), instrument).alias("title"),
        text.notification_body(
            F.col("status"), F.col("name"), instrument, F.col("error_message")
        ).alias("body"),
    )
    return told.join(devices.select("user_id", "token"), "user_id")


# --- reuse of earlier results ---


def dedup_key(jobs: DataFrame, version: str) -> Column:
    """The same user's same audio under the same pipeline version and full configuration."""
    config = F.from_json(
        "config", "instrument string, max_duration_s double, separation boolean, tuning string, capo int"
    )
    full = F.struct(
        F.coalesce(config["capo"], F.lit(0)).alias("capo"),
        config["instrument"].alias("instrument"),
        F.coalesce(config["max_duration_s"], F.lit(300.0)).alias("max_duration_s"),
        F.coalesce(config["separation"], F.lit(False)).alias("separation"),
        F.coalesce(config["tuning"], F.lit("standard")).alias("tuning"),
    )
    return text.canonical_hash(
        user_id=F.col("user_id").cast("string"),
        audio_sha256=F.col("audio_sha256"),
        pipeline_version=F.lit(version),
        config=full,
    )


def result_cache(jobs: DataFrame) -> DataFrame:
    """First succeeded job per dedup key."""
    done = jobs.where(F.col("status") == "succeeded").withColumn("cached_job_id", F.col("job_id"))
    return first_write_wins(done, ["dedup_key"], ["finished_at", "job_id"], ["cached_job_id"])


def files_present(needed: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys all of whose needed files are listed."""
    here = listed.select(*keys, "file", F.lit(True).alias("here"))
    return (
        needed.join(here, [*keys, "file"], "left")
        .groupBy(*keys)
        .agg(F.bool_and(F.col("here").isNotNull()).alias("whole"))
        .where("whole")
        .drop("whole")
    )


def reusable_results(
    jobs: DataFrame, version_files: DataFrame, listed: DataFrame
) -> DataFrame:
    """Jobs that can take over an earlier job's results, and that job.

    `jobs` carries `dedup_key`; `version_files` the files of each job's version 0.
    """
    whole = files_present(version_files, listed, ["job_id"])
    cache = result_cache(jobs)
    return (
        jobs.select("job_id", "dedup_key")
        .join(cache, "dedup_key")
        .where(F.col("cached_job_id") != F.col("job_id"))
        .join(whole.select(F.col("job_id").alias("cached_job_id")), "cached_job_id", "left_semi")
        .select("job_id", "cached_job_id")
    )


# --- the upload gate ---


def upload_gate(
    requests: DataFrame, users: DataFrame, effective: DataFrame, limit: int, window_s: int
) -> DataFrame:
    """Accept or refuse each upload request; the first failing check gives the status.

    Sizes are held against the plan in force, a purchase in `effective` (user_id, active) included.
    Only requests of users who accepted the current terms reach the rate limit, so only those count.
    """
    sizes = F.create_map(
        *[x for plan, row in PLAN_LIMITS.items() for x in (F.lit(plan), F.lit(row[2]).cast("bigint"))]
    )
    terms = users.select("user_id", (F.col("terms_version") == TERMS_VERSION).alias("terms"))
    plans = effective_plan(users, effective).select("user_id", "plan")
    with_user = requests.join(terms, "user_id", "left").join(plans, "user_id", "left").select(
        *requests.columns,
        F.coalesce("plan", F.lit("free")).alias("plan"),
        F.coalesce("terms", F.lit(False)).alias("terms"),
    )
    counted = rate_windows(with_user.where("terms"), "at", "request_id", limit, window_s).drop(
        "rate_window"
    )
    refused = with_user.where(~F.col("terms")).withColumn("admitted", F.lit(True))
    status = (
        F.when(~F.col("terms"), 403)
        .when(~F.col("admitted"), 429)
        .when(text.stored_extension(F.col("content_type")).isNull(), 415)
        .when(F.col("size_bytes") > sizes[F.col("plan")], 413)
        .otherwise(201)
    )
    return counted.unionByName(refused).select("request_id", "user_id", status.alias("status"))
