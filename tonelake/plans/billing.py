"""Subscriptions, plans and store events over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.functions import text
from tonelake.operators import billing as ops
from tonelake.operators import upserts
from tonelake.plans.registry import query
from tonelake.plans.role_sql import EVENTS_AS_OF, add_role, with_roles
from tonelake.sources import records
from tonelake.sources.roles import EVENTS_AS_OF as AS_OF
from tonelake.sources.roles import Roles, ts

PRODUCTS = ("pro:monthly", "pro:yearly", "plus", "lifetime")

add_role(
    "purchases",
    "messages",
    """SELECT user_id, (['pro:monthly', 'pro:yearly', 'plus', 'lifetime'])[k % 4 + 1] AS product_id,
         max(event_id) AS event_id, arg_max(k, event_id) AS k, arg_max(ts, event_id) AS ts
       FROM messages WHERE event_type = 'purchase' GROUP BY 1, 2""",
)
add_role(
    "subscriptions",
    "purchases",
    """SELECT user_id, CASE WHEN k % 5 = 0 THEN 'sandbox' ELSE 'production' END AS environment,
         (['app_store', 'play_store', 'promotional'])[k % 3 + 1] AS store, product_id,
         CASE WHEN product_id LIKE 'pro%' THEN 'pro_access' WHEN product_id = 'lifetime'
           THEN 'extras' END AS entitlement,
         CASE WHEN k % 7 = 0 THEN 'trial' ELSE 'normal' END AS period_type,
         date_trunc('second', ts) AS purchased_at,
         CASE WHEN k % 11 > 0 THEN date_trunc('second', ts) + to_days((k % 30)::INT) END AS expires_at,
         CASE WHEN k % 6 = 0 THEN date_trunc('second', ts) END AS billing_issue_at,
         CASE WHEN k % 6 = 0 AND k % 11 > 0 THEN date_trunc('second', ts)
           + to_days((k % 30 + 6)::INT) END AS grace_period_expires_at,
         CASE WHEN k % 4 = 1 THEN date_trunc('second', ts) END AS unsubscribed_at,
         CASE WHEN k % 13 = 0 THEN date_trunc('second', ts) END AS refunded_at
       FROM purchases""",
)
add_role(
    "effective",
    "subscriptions users",
    f"""SELECT *, refunded_at IS NULL AND coalesce(expires_at > {EVENTS_AS_OF}
          OR coalesce(grace_period_expires_at > {EVENTS_AS_OF}, false), true) AS active
        FROM subscriptions WHERE entitlement = 'pro_access' AND (store = 'promotional'
          OR environment = 'production' OR user_id IN (SELECT user_id FROM users
            WHERE plan_changed_by IS NOT NULL))
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY refunded_at IS NULL
          AND coalesce(expires_at > {EVENTS_AS_OF}
            OR coalesce(grace_period_expires_at > {EVENTS_AS_OF}, false), true) DESC,
          coalesce(greatest(expires_at, grace_period_expires_at), TIMESTAMP '9999-01-01') DESC,
          product_id) = 1""",
)
_FLAGS = """SELECT user_id, active, expires_at, period_type = 'trial' AS in_trial,
    active AND unsubscribed_at IS NULL AND refunded_at IS NULL AND store <> 'promotional'
      AS will_renew, billing_issue_at IS NOT NULL AS billing_issue,
    refunded_at IS NOT NULL AS refunded FROM effective"""


def subscriber_documents(r: Roles):
    """Store documents as the provider returns them: one JSON text per user.

    A user's newest purchase of each product is kept first, so a document holds four products at
    most however many purchases there are.
    """
    k = F.col("k")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def later(days, condition):
        moved = F.col("ts") + F.make_dt_interval(days=days.cast("int"))
        return F.when(condition, F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss'Z'"))

    stores = F.array(F.lit("app_store"), F.lit("play_store"), F.lit("promotional"))
    purchases = r.messages().where(F.col("event_type") == "purchase")
    product = F.element_at(F.array(*map(F.lit, PRODUCTS)), (k % 4 + 1).cast("int"))
    newest = upserts.last_write_wins(
        purchases.withColumn("product_id", product), ["user_id", "product_id"], ["event_id"], ["k", "ts"]
    )
    sub = F.struct(
        (k % 5 == 0).alias("is_sandbox"),
        F.element_at(stores, (k % 3 + 1).cast("int")).alias("store"),
        F.when(k % 7 == 0, "trial").otherwise("normal").alias("period_type"),
        at.alias("purchase_date"),
        later(k % 30, k % 11 > 0).alias("expires_date"),
        F.when(k % 6 == 0, at).alias("billing_issues_detected_at"),
        later(k % 30 + 6, (k % 6 == 0) & (k % 11 > 0)).alias("grace_period_expires_date"),
        F.when(k % 4 == 1, at).alias("unsubscribe_detected_at"),
        F.when(k % 13 == 0, at).alias("refunded_at"),
    )
    grants = F.create_map(
        F.lit("pro_access"),
        F.struct(F.lit("pro").alias("product_identifier")),
        F.lit("extras"),
        F.struct(F.lit("lifetime").alias("product_identifier")),
    )
    docs = newest.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("product_id", sub))).alias("subscriptions")
    )
    body = F.struct(F.struct("subscriptions", grants.alias("entitlements")).alias("subscriber"))
    return docs.select("user_id", F.to_json(body).alias("body"))


def subscriptions(r: Roles):
    return records.subscribers(subscriber_documents(r))


def allowed(r: Roles):
    return r.users().where(F.col("plan_changed_by").isNotNull()).select("user_id")


def counted(r: Roles):
    return ops.purchases_that_count(subscriptions(r), allowed(r), "production", "pro_access")


def effective(r: Roles):
    return ops.effective_subscription(counted(r), ts(AS_OF))


@query(
    "s3_subscriber_rows",
    with_roles(
        "subscriptions",
        """SELECT user_id, environment, store, product_id, coalesce(entitlement, '-') AS entitlement,
          period_type, purchased_at, expires_at, grace_period_expires_at, refunded_at
        FROM subscriptions""",
    ),
)
def subscriber_rows(r: Roles):
    return subscriptions(r).select(
        "user_id", "environment", "store", "product_id",
        F.coalesce("entitlement", F.lit("-")).alias("entitlement"), "period_type", "purchased_at",
        "expires_at", "grace_period_expires_at", "refunded_at",
    )


@query(
    "p12_purchases_that_count",
    with_roles(
        "subscriptions users",
        """SELECT user_id, product_id, store, environment FROM subscriptions
        WHERE entitlement = 'pro_access' AND (store = 'promotional' OR environment = 'production'
          OR user_id IN (SELECT user_id FROM users WHERE plan_changed_by IS NOT NULL))""",
    ),
)
def purchases_that_count(r: Roles):
    return counted(r).select("user_id", "product_id", "store", "environment")


@query(
    "j21_allow_list_spread",
    with_roles(
        "subscriptions users",
        """SELECT environment, u.user_id IS NOT NULL AS allowed, count(*) AS purchases
        FROM subscriptions s LEFT JOIN (SELECT user_id FROM users WHERE plan_changed_by IS NOT NULL)
          u USING (user_id) GROUP BY 1, 2""",
    ),
)
def allow_list_spread(r: Roles):
    listed = allowed(r).withColumn("listed", F.lit(True))
    return (
        subscriptions(r)
        .join(listed, "user_id", "left")
        .groupBy("environment", F.col("listed").isNotNull().alias("allowed"))
        .agg(F.count(F.lit(1)).alias("purchases"))
    )


@query(
    "w3_effective_subscription",
    with_roles(
        "effective", "SELECT user_id, product_id, store, active, expires_at FROM effective"
    ),
)
def effective_subscription(r: Roles):
    return effective(r).select("user_id", "product_id", "store", "active", "expires_at")


@query(
    "f13_access_rule",
    with_roles(
        "subscriptions",
        f"""SELECT user_id, product_id, refunded_at IS NULL AND coalesce(expires_at > {EVENTS_AS_OF}
          OR coalesce(grace_period_expires_at > {EVENTS_AS_OF}, false), true) AS active
        FROM subscriptions""",
    ),
)
def access_rule(r: Roles):
    return subscriptions(r).select(
        "user_id", "product_id", ops.gives_access(ts(AS_OF)).alias("active")
    )


_PLANS = """SELECT user_id, CASE WHEN by_store THEN 'pro' ELSE plan END AS plan,
    CASE WHEN by_store THEN 'store' WHEN changed THEN 'admin' ELSE 'default' END AS source
  FROM (SELECT user_id, coalesce(plan, 'free') AS plan, plan_changed_by IS NOT NULL AS changed,
      coalesce(active, false) AND coalesce(plan, 'free') <> 'unlimited' AS by_store
    FROM users FULL JOIN effective USING (user_id))"""


add_role("plans", "users effective", _PLANS)


@query("w4_effective_plan", with_roles("users effective", _PLANS))
def effective_plan(r: Roles):
    return ops.effective_plan(r.users(), effective(r))


@query(
    "f14_plan_limits",
    with_roles(
        "users effective",
        f"""SELECT user_id, plan, source, coalesce(CASE plan WHEN 'free' THEN 10 WHEN 'pro' THEN 100
            END, -1)::BIGINT AS jobs_per_month,
          CASE plan WHEN 'free' THEN 300 ELSE 900 END::BIGINT AS max_clip_s,
          CASE plan WHEN 'free' THEN 67108864 ELSE 201326592 END::BIGINT AS max_upload_bytes,
          CASE plan WHEN 'free' THEN 'normal' ELSE 'high' END AS priority FROM ({_PLANS})""",
    ),
)
def plan_limits(r: Roles):
    limits = ops.with_limits(ops.effective_plan(r.users(), effective(r)))
    return limits.withColumn("jobs_per_month", F.coalesce("jobs_per_month", F.lit(-1)))


@query("f12_subscription_flags", with_roles("effective", _FLAGS))
def subscription_flags(r: Roles):
    return ops.subscription_flags(effective(r))


@query(
    "f11_status_lines",
    with_roles(
        "effective",
        f"""SELECT user_id, CASE WHEN refunded THEN 'Refunded'
          WHEN active AND billing_issue
            THEN 'Payment problem: update your payment method in the app store to keep Pro.'
          WHEN NOT active THEN coalesce('Pro ended on ' || d, 'Pro ended') WHEN d IS NULL THEN NULL
          WHEN in_trial THEN CASE WHEN will_renew THEN 'Free trial · Pro starts on ' || d
            ELSE 'Free trial ends on ' || d END
          WHEN will_renew THEN 'Renews on ' || d ELSE 'Ends on ' || d END AS line
        FROM (SELECT *, strftime(expires_at, '%-d %b %Y') AS d FROM ({_FLAGS}))""",
    ),
)
def status_lines(r: Roles):
    return ops.subscription_flags(effective(r)).select("user_id", ops.status_line().alias("line"))


@query(
    "j8_replace_subscriptions",
    with_roles(
        "subscriptions messages",
        """WITH synced AS (SELECT DISTINCT user_id FROM messages WHERE event_type = 'error'
            AND k % 9 = 0)
        SELECT user_id, product_id, 'stored' AS origin FROM subscriptions
          WHERE user_id NOT IN (SELECT user_id FROM synced)
        UNION ALL SELECT user_id, product_id, 'fresh' FROM subscriptions
          WHERE user_id IN (SELECT user_id FROM synced) AND user_id % 3 <> 0""",
    ),
)
def replace_subscriptions(r: Roles):
    stored = subscriptions(r).select("user_id", "product_id", F.lit("stored").alias("origin"))
    synced = r.messages().where((F.col("event_type") == "error") & (F.col("k") % 9 == 0))
    fresh = (
        stored.where(F.col("user_id") % 3 != 0)
        .join(synced.select("user_id").distinct(), "user_id", "left_semi")
        .withColumn("origin", F.lit("fresh"))
    )
    return upserts.replace_by_key(stored, synced, fresh, "user_id")


# --- store events ---


def webhook_bodies(r: Roles):
    """Store events as delivered: JSON text with extra fields and two id lists."""
    k = F.col("k")
    kinds = F.array(*map(F.lit, ["RENEWAL", "TRANSFER", "CANCELLATION", "TEST", "EXPIRATION"]))
    anonymous = F.concat(F.lit("$RCAnonymousID:"), k.cast("string"))
    user = F.col("user_id").cast("string")
    event = F.struct(
        F.format_string("evt-%d", "event_id").alias("id"),
        F.element_at(kinds, (k % 5 + 1).cast("int")).alias("type"),
        F.when(k % 8 == 0, "SANDBOX").when(k % 8 == 1, "LOCAL").when(k % 8 > 2, "PRODUCTION").alias(
            "environment"
        ),
        F.when(k % 10 == 9, anonymous).otherwise(user).alias("app_user_id"),
        F.when(k % 4 == 0, anonymous).otherwise(user).alias("original_app_user_id"),
        F.when(k % 5 == 1, F.array((F.col("user_id") + k).cast("string"), user)).alias(
            "transferred_from"
        ),
        F.lit("app_store").alias("store"),
        F.expr("unix_micros(ts) div 1000").alias("event_timestamp_ms"),
        F.lit("extra").alias("unlisted_field"),
    )
    return r.messages().select(F.to_json(F.struct(event.alias("event"))).alias("body"))


add_role(
    "hooks",
    "messages",
    """SELECT 'evt-' || event_id AS event_id,
         (['RENEWAL','TRANSFER','CANCELLATION','TEST','EXPIRATION'])[k % 5 + 1] AS type,
         CASE WHEN k % 8 = 0 THEN 'SANDBOX' WHEN k % 8 = 1 THEN 'LOCAL' ELSE 'PRODUCTION' END
           AS environment,
         make_timestamp((epoch_us(ts) // 1000) * 1000) AS event_at,
         CASE WHEN k % 10 = 9 AND k % 4 = 0 AND k % 5 <> 1 THEN []
           WHEN k % 5 = 1 AND k % 10 = 9 AND k % 4 = 0 THEN list_distinct([user_id + k, user_id])
           WHEN k % 5 = 1 AND k > 0 THEN [user_id, user_id + k] ELSE [user_id] END AS ids
       FROM messages""",
)


@query(
    "s4_webhook_landing",
    with_roles(
        "hooks", "SELECT event_id, type, environment, 'app_store' AS store, event_at FROM hooks"
    ),
)
def webhook_landing(r: Roles):
    landed = records.webhooks(webhook_bodies(r))
    return landed.select("event_id", "type", "environment", "store", "event_at")


_IDS = with_roles(
    "hooks",
    """SELECT event_id, array_to_string(ids, ',') AS user_ids FROM hooks""",
)


@query("x3_event_user_ids", _IDS)
def event_user_ids(r: Roles):
    landed = records.webhooks(webhook_bodies(r))
    return landed.select("event_id", F.array_join("user_ids", ",").alias("user_ids"))


@query(
    "f27_known_ids",
    """SELECT event_id, array_to_string(CASE WHEN user_id = event_id % 50 THEN [user_id]
         ELSE [user_id, event_id % 50] END, ',') AS ids FROM events""",
)
def known_ids(r: Roles):
    ids = F.array(
        F.col("user_id").cast("string"),
        F.lit("$RCAnonymousID:x"),
        (F.col("event_id") % 50).cast("string"),
        F.lit(None),
        F.col("user_id").cast("string"),
        F.repeat(F.lit("x"), 129),
    )
    return r.messages().select("event_id", F.array_join(text.known_ids(ids), ",").alias("ids"))


@query(
    "j5_events_of_known_users",
    with_roles(
        "hooks users",
        """SELECT DISTINCT event_id, user_id FROM (SELECT event_id, unnest(ids) AS user_id FROM hooks)
        WHERE user_id IN (SELECT user_id FROM users)""",
    ),
)
def events_of_known_users(r: Roles):
    named = records.webhooks(webhook_bodies(r)).select(
        "event_id", F.explode(F.col("user_ids").cast("array<bigint>")).alias("user_id")
    )
    return named.join(r.users().select("user_id"), "user_id", "left_semi")


@query(
    "r1_event_outcomes_batch",
    with_roles(
        "hooks users",
        """WITH n AS (SELECT event_id, type, environment, u, environment = 'PRODUCTION'
            OR (environment = 'SANDBOX' AND u IN (SELECT user_id FROM users
              WHERE plan_changed_by IS NOT NULL)) AS counts,
            u IN (SELECT user_id FROM users) AS known
          FROM hooks LEFT JOIN (SELECT event_id, unnest(ids) AS u FROM hooks) USING (event_id)),
        g AS (SELECT event_id, type, environment, count(u) AS ids,
            count(*) FILTER (u IS NOT NULL AND counts) AS counted,
            count(*) FILTER (counts AND known) AS known FROM n GROUP BY ALL)
        SELECT event_id, CASE WHEN type = 'TEST' THEN 'test'
          WHEN environment = 'LOCAL' OR (ids > 0 AND counted = 0) THEN 'other_environment'
          WHEN known = 0 THEN 'unknown_user' ELSE 'synced' END AS outcome FROM g""",
    ),
)
def event_outcomes_batch(r: Roles):
    landed = records.webhooks(webhook_bodies(r))
    ids = landed.withColumn("user_ids", F.col("user_ids").cast("array<bigint>"))
    return ops.event_outcomes(ids, r.users(), allowed(r), "production")
