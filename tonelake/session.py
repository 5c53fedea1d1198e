"""Session settings and the shared scratch location."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tonelake", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators rely on.

    Partition counts are left to AQE: `coalescePartitions` shrinks small shuffles and `skewJoin`
    splits a hot join key, so nothing here is tuned to one machine.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return utc(builder.getOrCreate())


def utc(spark: SparkSession) -> SparkSession:
    """Every day, week and month boundary in this package is a UTC one."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's checkpoint folder if it names one, or else
    its warehouse, which is shared by definition. No folder is made up and no setting changed."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/tonelake/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and go on from the written table.

    For a costly step that several later branches read: it runs once, a lost executor cannot make
    it run again, and the files' statistics let Spark plan the joins that follow.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
