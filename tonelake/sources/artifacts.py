"""Stored files: inventories, integrity against manifests, backup retention, result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions.constants import BACKUP_KEEP_DAYS


def read_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """Every file below `root` with its size and SHA-256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def below_prefix(listing: DataFrame, prefix: str) -> DataFrame:
    """Objects below one prefix, which must end in "/" so it cannot match a longer name."""
    if not prefix.endswith("/"):
        raise ValueError("a prefix must end in '/'")
    return listing.where(F.col("key").startswith(prefix))


def inventory(listing: DataFrame, depth: int) -> DataFrame:
    """Objects and bytes below each prefix of `depth` segments."""
    prefix = F.concat(F.substring_index("key", "/", depth), F.lit("/"))
    return listing.groupBy(prefix.alias("prefix")).agg(
        F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes")
    )


def intact_outputs(manifests: DataFrame, files: DataFrame, keys: DataFrame) -> DataFrame:
    """Manifests whose cache key is the expected one and whose files are all unchanged.

    `manifests` has one row per listed file: (unit, stage, cache_key, path, sha256).
    """
    actual = files.select("path", F.col("sha256").alias("actual"))
    checked = (
        manifests.join(actual, "path", "left")
        .groupBy("unit", "stage", "cache_key")
        .agg(
            F.bool_and(F.coalesce(F.col("actual") == F.col("sha256"), F.lit(False))).alias("whole")
        )
    )
    return checked.where("whole").join(keys, ["unit", "stage", "cache_key"], "left_semi").drop(
        "whole"
    )


def expired_backups(objects: DataFrame, as_of: Column, keep_days: int = BACKUP_KEEP_DAYS):
    """Objects older than the retention, except the newest key, which always stays."""
    newest = objects.agg(F.max("key").alias("newest"))  # one row
    old = objects.where(F.col("modified_at") < as_of - F.expr(f"INTERVAL {keep_days} DAYS"))
    return old.join(newest, F.col("key") == F.col("newest"), "left_anti")
