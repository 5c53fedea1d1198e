"""Rate limits and monthly quotas, without ranking a busy user's whole history in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.operators.sliced import running_sum
from tonelake.session import settle


def admit_first(
    df: DataFrame, keys: list[str], order: list[str], limit: int, flag: str = "admitted"
) -> DataFrame:
    """Flag the first `limit` rows of each key.

    Only the row at the limit is looked for: `row_number() <= limit` is cut down before the
    shuffle, so each map task sends at most `limit` rows per key. The rest of the table is
    compared with that row through a join, which AQE can split for a hot key.
    """
    if limit <= 0:
        return df.withColumn(flag, F.lit(False))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    last = (
        df.select(*dict.fromkeys([*keys, *order]))
        .withColumn("place", place)
        .where(F.col("place") <= limit)
        .where(F.col("place") == limit)
        .select(*keys, F.struct(*order).alias("last_admitted"))
    )
    return df.join(last, keys, "left").select(
        *df.columns,
        (F.col("last_admitted").isNull() | (F.struct(*order) <= F.col("last_admitted"))).alias(flag),
    )


def rate_windows(
    attempts: DataFrame, at: str, key: str, limit: int, window_s: int
) -> DataFrame:
    """Fixed windows: every attempt counts, the first `limit` of each (user, window) pass."""
    windowed = attempts.withColumn(
        "rate_window", F.expr(f"unix_seconds({at}) div {window_s}")
    )
    return admit_first(windowed, ["user_id", "rate_window"], [at, key], limit)


_MONTH = ["user_id", "month"]
_ENTRY = ["at", "entry_id"]


def _below_limits(rows: DataFrame) -> DataFrame:
    """`before` and `counted`, the counter around each row, while no attempt meets a lower limit.

    An attempt turns a count c into min(c + 1, its limit), a refund into c - 1. Steps of that kind
    add up: after any of them the count is the running sum T plus min(0, the least of limit - T
    over the attempts so far). Limits may differ from row to row. Running sums and minima are taken
    inside hourly slices; one row per (user, slice) is ordered across a month.
    """
    at = Window.partitionBy(*_MONTH, "slice").orderBy(*_ENTRY)
    here = at.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = at.rowsBetween(Window.unboundedPreceding, -1)
    slack = F.when(~F.col("is_refund"), F.col("month_limit") - F.col("_sum"))
    local = (
        rows.withColumn("_sum", F.sum("step").over(here))
        .withColumn("_slack", slack)
        .withColumn("_low", F.min("_slack").over(here))
        .withColumn("_low_before", F.min("_slack").over(earlier))
    )
    slices = Window.partitionBy(*_MONTH).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        local.groupBy(*_MONTH, "slice")
        .agg(F.sum("step").alias("_total"), F.min("_slack").alias("_least"), F.min("opening").alias("_open"))
        .withColumn("_base", F.col("_open") + F.coalesce(F.sum("_total").over(slices), F.lit(0)))
        .withColumn("_past", F.min(F.col("_least") - F.col("_base")).over(slices))
        .select(*_MONTH, "slice", "_base", "_past")
    )

    def level(sum_: Column, low: Column) -> Column:
        return F.col("_base") + sum_ + F.least(F.lit(0), low - F.col("_base"), F.col("_past"))

    return local.join(carry, [*_MONTH, "slice"]).select(
        *rows.columns,
        level(F.col("_sum") - F.col("step"), F.col("_low_before")).alias("before"),
        level(F.col("_sum"), F.col("_low")).alias("counted"),
    )


def quota_admission(
    ledger: DataFrame, carried: DataFrame | None = None, slice_s: int = 3600
) -> DataFrame:
    """Monthly quota with refunds, whatever happens to the limit within a month.

    `ledger` has (entry_id, user_id, at, is_refund, month_limit); a null limit admits everything.
    An attempt adds one if the count is below its limit, a refund takes one off; a refused attempt
    changes nothing. `carried` has the counter to start from, (user_id, month, counted).

    Where a limit falls below what is already counted, attempts are refused until refunds have
    brought the count down to a limit again. Those stretches need the number of refunds only, and
    the rows after them go on as a ledger of their own. So the work is done in rounds, as many as
    the most times a user's limit fell below their count in a month, over ever fewer rows; no
    user's rows are walked one by one, and each round is written before the next one reads it.
    """
    slice_ = F.expr(f"unix_seconds(at) div {slice_s}")
    step = F.when(F.col("is_refund"), F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
    rows = ledger.select("*", F.date_format("at", "yyyy-MM").alias("month"), slice_.alias("slice"), step.alias("step"))
    if carried is not None:
        opening = carried.select(*_MONTH, F.col("counted").cast("bigint").alias("opening"))
        rows = rows.join(opening, _MONTH, "left").withColumn("opening", F.coalesce("opening", F.lit(0)))
    else:
        rows = rows.withColumn("opening", F.lit(0).cast("bigint"))
    names = [*ledger.columns, "month"]
    place = F.struct(*_ENTRY)
    parts = []
    while True:
        found = settle(_below_limits(rows), "quota")
        admitted = (~F.col("is_refund") & (F.col("counted") > F.col("before"))).alias("admitted")
        fell = found.where(~F.col("is_refund") & (F.col("counted") < F.col("before")))
        first = fell.groupBy(*_MONTH).agg(F.min_by("before", place).alias("held"), F.min(place).alias("_from"))
        if fell.isEmpty():
            parts.append(found.select(*names, admitted, "counted"))
            return reduce(DataFrame.unionByName, parts)
        marked = found.join(first, _MONTH, "left")
        settled = F.col("_from").isNull() | (place < F.col("_from"))
        parts.append(marked.where(settled).select(*names, admitted, "counted"))
        refund = F.col("is_refund").cast("bigint")
        over = running_sum(
            marked.where(~settled).withColumn("_refund", refund), _MONTH, F.col("slice"), _ENTRY, "_refund", "_refunds"
        ).withColumn("_level", F.col("held") - F.col("_refunds"))
        over = settle(over, "over_limit")
        fits = F.col("month_limit").isNull() | (F.col("_level") <= F.col("month_limit"))
        resumed = (
            over.where(~F.col("is_refund") & fits)
            .groupBy(*_MONTH)
            .agg(F.min(place).alias("_again"), F.min_by("_level", place).alias("_opening"))
        )
        split = over.join(resumed, _MONTH, "left")
        on = place >= F.col("_again")
        parts.append(
            split.where(F.col("_again").isNull() | ~on).select(
                *names, F.lit(False).alias("admitted"), F.col("_level").alias("counted")
            )
        )
        rows = split.where(on).withColumn("opening", F.col("_opening")).select(*rows.columns)


def monthly_usage(admissions: DataFrame) -> DataFrame:
    """Jobs counted per user and UTC month, never below zero."""
    step = F.when(F.col("is_refund"), -1).when(F.col("admitted"), 1).otherwise(0)
    return admissions.groupBy("user_id", "month").agg(
        F.greatest(F.lit(0).cast("bigint"), F.sum(step)).alias("used")
    )
