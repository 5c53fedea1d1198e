"""Exact interpolated percentiles that never hold a whole group in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BUCKETS = 1024


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """One row per key with `runs` and each named continuous percentile of `value`.

    Values are counted first, then counted again in at most 1024 equal ranges per key. The running
    counts over those ranges say which range holds each wanted rank, and only the values in those
    ranges are ordered. A key with a third of the table costs no more ordering than any other. Keys are
    held in one struct, which is never null itself, so joins on it keep the grouping's partitioning
    and a null key is a key like any other.
    """
    names, keys = keys, ["_key"]
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.struct(*names).alias("_key"), F.col(value).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bounds = counted.groupBy(*keys).agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("runs")
    )
    width = (F.col("high") - F.col("low")) / _BUCKETS
    placed = counted.join(bounds, keys).withColumn(
        "bucket",
        F.when(F.col("high") > F.col("low"), F.floor((F.col("v") - F.col("low")) / width)).otherwise(
            F.lit(0)
        ),
    )
    by_bucket = Window.partitionBy(*keys).orderBy("bucket")
    ranges = (
        placed.groupBy(*keys, "bucket")
        .agg(F.sum("n").alias("bucket_n"), F.max("runs").alias("total"))
        .withColumn(
            "before",
            F.sum("bucket_n").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)),
        )
        .withColumn("before", F.coalesce("before", F.lit(0)))
    )
    wanted = F.lit(False)
    for q in quantiles.values():
        low = F.floor((F.col("total") - 1) * q)
        wanted = wanted | (
            (F.col("before") <= low + 1) & (F.col("before") + F.col("bucket_n") > low)
        )
    kept = ranges.where(wanted).select(*keys, "bucket", "before")
    in_bucket = Window.partitionBy(*keys, "bucket").orderBy("v")
    ranked = (
        placed.join(kept, [*keys, "bucket"])
        .withColumn(
            "upto", F.col("before") + F.sum("n").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0))
        )
        .withColumn("from_rank", F.col("upto") - F.col("n"))
    )
    picks, results = [], []
    for i, (name, q) in enumerate(quantiles.items()):
        position = (F.col("runs") - 1) * F.lit(q)
        low = F.floor(position)
        for tag, rank in (("lo", low), ("hi", F.least(low + 1, F.col("runs") - 1))):
            held = (F.col("from_rank") <= rank) & (F.col("upto") > rank)
            picks.append(F.max(F.when(held, F.col("v"))).alias(f"{tag}{i}"))
        results.append(
            (
                F.col(f"lo{i}")
                + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (position - F.floor(position))
            ).alias(name)
        )
    own = [F.col(f"_key.{name}").alias(name) for name in names]
    return ranked.groupBy(*keys, "runs").agg(*picks).select(*own, "runs", *results)
