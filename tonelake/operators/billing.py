"""Store subscriptions: which count, which one applies, the plan it gives and how it reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.constants import PLAN_LIMITS, PLAN_RANK, PROMOTIONAL


def gives_access(as_of: Column) -> Column:
    """Not refunded, and without an end or with the paid or grace period still running."""
    grace = F.col("grace_period_expires_at")
    running = (F.col("expires_at") > as_of) | F.coalesce(grace > as_of, F.lit(False))
    return F.col("refunded_at").isNull() & F.coalesce(running, F.lit(True))


def purchases_that_count(
    subscriptions: DataFrame, allowed: DataFrame, environment: str, entitlement: str
) -> DataFrame:
    """Purchases for the entitlement that count on a server of this environment.

    `allowed` lists the users whose sandbox purchases count anyway; promotional grants always do.
    """
    marked = allowed.select("user_id", F.lit(True).alias("allowed")).distinct()
    counts = (
        (F.col("store") == PROMOTIONAL)
        | (F.col("environment") == environment)
        | ((F.col("environment") == "sandbox") & F.coalesce("allowed", F.lit(False)))
    )
    wanted = subscriptions.where(F.col("entitlement") == entitlement)
    return wanted.join(marked, "user_id", "left").where(counts).drop("allowed")


def effective_subscription(counted: DataFrame, as_of: Column) -> DataFrame:
    """Per user the subscription that applies: an active one first, then the one ending last."""
    ends = F.coalesce(
        F.unix_micros(F.greatest("expires_at", "grace_period_expires_at")), F.lit(2**62)
    )
    rows = counted.withColumn("active", gives_access(as_of))
    fields = [c for c in rows.columns if c != "user_id"]
    best = F.min_by(F.struct(*fields), F.struct(~F.col("active"), -ends, F.col("product_id")))
    return rows.groupBy("user_id").agg(best.alias("s")).select("user_id", "s.*")


def effective_plan(users: DataFrame, effective: DataFrame) -> DataFrame:
    """The higher of the store's Pro and the stored plan; the store wins a tie."""
    rank = F.create_map(*[F.lit(x) for pair in PLAN_RANK.items() for x in pair])
    stored = F.coalesce("plan", F.lit("free"))
    by_store = F.coalesce("active", F.lit(False)) & (rank[stored] <= PLAN_RANK["pro"])
    source = F.when(F.col("plan_changed_by").isNotNull(), "admin").otherwise("default")
    return (
        users.select("user_id", "plan", "plan_changed_by")
        .join(effective.select("user_id", "active"), "user_id", "full_outer")
        .select(
            "user_id",
            F.when(by_store, "pro").otherwise(stored).alias("plan"),
            F.when(by_store, "store").otherwise(source).alias("source"),
        )
    )


def with_limits(plans: DataFrame) -> DataFrame:
    """Each row's plan spelled out as its limits; the lookup is a handful of constants."""
    def pick(i: int) -> Column:
        value = F.lit(None)
        for plan, row in PLAN_LIMITS.items():
            value = F.when(F.col("plan") == plan, F.lit(row[i])).otherwise(value)
        return value

    return plans.withColumns(
        {
            "jobs_per_month": pick(0).cast("bigint"),
            "max_clip_s": pick(1).cast("bigint"),
            "max_upload_bytes": pick(2).cast("bigint"),
            "priority": pick(3),
        }
    )


def subscription_flags(effective: DataFrame) -> DataFrame:
    return effective.select(
        "user_id",
        "active",
        "expires_at",
        (F.col("period_type") == "trial").alias("in_trial"),
        (
            F.col("active")
            & F.col("unsubscribed_at").isNull()
            & F.col("refunded_at").isNull()
            & (F.col("store") != PROMOTIONAL)
        ).alias("will_renew"),
        F.col("billing_issue_at").isNotNull().alias("billing_issue"),
        F.col("refunded_at").isNotNull().alias("refunded"),
    )


def status_line(store_name: str = "the app store") -> Column:
    """One line about a subscription's flags, or null when there is nothing to say."""
    date = F.date_format("expires_at", "d MMM yyyy")

    def line(prefix: str) -> Column:
        return F.concat(F.lit(prefix), date)

    return (
        F.when(F.col("refunded"), "Refunded")
        .when(
            F.col("active") & F.col("billing_issue"),
            f"Payment problem: update your payment method in {store_name} to keep Pro.",
        )
        .when(~F.col("active"), F.coalesce(line("Pro ended on "), F.lit("Pro ended")))
        .when(date.isNull(), F.lit(None))
        .when(
            F.col("in_trial"),
            F.when(F.col("will_renew"), line("Free trial · Pro starts on ")).otherwise(
                line("Free trial ends on ")
            ),
        )
        .otherwise(F.when(F.col("will_renew"), line("Renews on ")).otherwise(line("Ends on ")))
    )


def event_outcomes(
    events: DataFrame, users: DataFrame, allowed: DataFrame, environment: str
) -> DataFrame:
    """What each store event leads to. An event only names users; their state is read afresh.

    `events` has (event_id, type, environment, user_ids).
    """
    named = events.select(
        "event_id", "type", "environment", F.explode_outer("user_ids").alias("user_id")
    )
    marks = (
        named.join(
            allowed.select("user_id", F.lit(True).alias("allowed")).distinct(), "user_id", "left"
        )
        .join(users.select("user_id", F.lit(True).alias("known")).distinct(), "user_id", "left")
        .withColumn("env", F.lower("environment"))
        .withColumn(
            "counts",
            (F.col("env") == environment)
            | ((F.col("env") == "sandbox") & F.coalesce("allowed", F.lit(False))),
        )
    )
    folded = marks.groupBy("event_id", "type", "env").agg(
        F.count("user_id").alias("ids"),
        F.count_if(F.col("user_id").isNotNull() & F.col("counts")).alias("counted"),
        F.count_if(F.col("counts") & F.col("known")).alias("known"),
    )
    outcome = (
        F.when(F.col("type") == "TEST", "test")
        .when(~F.col("env").isin("production", "sandbox"), "other_environment")
        .when((F.col("ids") > 0) & (F.col("counted") == 0), "other_environment")
        .when(F.col("known") == 0, "unknown_user")
        .otherwise("synced")
    )
    return folded.select("event_id", outcome.alias("outcome"))
