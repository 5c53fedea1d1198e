"""Keyed writes as DataFrames: insert-if-absent, merge, replace, erase, and the audit of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_write_wins(
    writes: DataFrame, keys: list[str], order: list[str], values: list[str]
) -> DataFrame:
    """The newest write per key. `max_by` combines on the map side, so a busy key costs one row."""
    newest = F.max_by(F.struct(*values), F.struct(*order)).alias("newest")
    return (
        writes.groupBy(*keys)
        .agg(newest)
        .select(*keys, *[F.col(f"newest.{v}").alias(v) for v in values])
    )


def first_write_wins(
    writes: DataFrame, keys: list[str], order: list[str], values: list[str]
) -> DataFrame:
    oldest = F.min_by(F.struct(*values), F.struct(*order)).alias("oldest")
    return (
        writes.groupBy(*keys)
        .agg(oldest)
        .select(*keys, *[F.col(f"oldest.{v}").alias(v) for v in values])
    )


def insert_if_absent(
    current: DataFrame, writes: DataFrame, keys: list[str], order: list[str]
) -> DataFrame:
    """Current rows plus the first write of every key that has none."""
    values = [c for c in current.columns if c not in keys]
    fresh = first_write_wins(writes, keys, order, values)
    return current.unionByName(fresh.join(current, keys, "left_anti"))


def merge(current: DataFrame, writes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert column by column: a write's null leaves the stored value alone."""
    values = [c for c in current.columns if c not in keys]
    newest = writes.groupBy(*keys).agg(
        *[
            F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(f"new_{v}")
            for v in values
        ]
    )
    joined = current.join(newest, keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(f"new_{v}", v).alias(v) for v in values])


def replace_by_key(
    current: DataFrame, synced: DataFrame, fresh: DataFrame, key: str
) -> DataFrame:
    """Rows of every synced key are replaced by its fresh set, which may be empty."""
    return current.join(synced.select(key).distinct(), key, "left_anti").unionByName(fresh)


def erase(df: DataFrame, erased: DataFrame, key: str) -> DataFrame:
    """Rows that do not belong to an erased key."""
    return df.join(erased.select(F.col("user_id").alias(key)).distinct(), key, "left_anti")


def erase_by_member(df: DataFrame, erased: DataFrame, row_key: str, members: str) -> DataFrame:
    """Rows whose member array names no erased user.

    The arrays are exploded and matched on the id (an equi-join), so the erasure list can be any
    size; the rows found are then removed by their own key.
    """
    hits = (
        df.select(row_key, F.explode(members).alias("user_id"))
        .join(erased.select("user_id").distinct(), "user_id", "left_semi")
        .select(row_key)
        .distinct()
    )
    return df.join(hits, row_key, "left_anti")


def change_audit(requests: DataFrame, current: DataFrame) -> DataFrame:
    """Each plan request with the plan it replaced: the one before it, else the stored one, else free.

    A user's earlier request is found inside (user, day) first and then across days, so a user with
    very many requests is spread over days; only one row per (user, day) is ordered across days.
    """
    in_day = Window.partitionBy("user_id", "day").orderBy("at", "request_id")
    dated = requests.withColumn("day", F.to_date("at"))
    closing = dated.groupBy("user_id", "day").agg(
        F.max_by("plan", F.struct("at", "request_id")).alias("closing")
    )
    opening = closing.select(
        "user_id",
        "day",
        F.lag("closing").over(Window.partitionBy("user_id").orderBy("day")).alias("opening"),
    )
    return (
        dated.withColumn("same_day", F.lag("plan").over(in_day))
        .join(opening, ["user_id", "day"])
        .join(current.select("user_id", F.col("plan").alias("stored")), "user_id", "left")
        .select(
            "request_id",
            "user_id",
            "at",
            F.coalesce("same_day", "opening", "stored", F.lit("free")).alias("from_plan"),
            F.col("plan").alias("to_plan"),
            "note",
        )
    )
