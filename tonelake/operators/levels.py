"""Loudness and level rules over block powers. Blocks of a clip are bounded by its length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions import constants as k


def silence() -> Column:
    return F.lit(float("-inf"))


def lufs(mean_square: Column) -> Column:
    return F.when(mean_square > 0, F.lit(-0.691) + 10 * F.log10(mean_square)).otherwise(silence())


def gating_blocks(sub_blocks: DataFrame) -> DataFrame:
    """Mean power of every four consecutive sub-blocks: (clip_id, block, power)."""
    four = Window.partitionBy("clip_id").orderBy("block").rowsBetween(-3, 0)
    return (
        sub_blocks.withColumn("held", F.count(F.lit(1)).over(four))
        .withColumn("power", F.avg("power").over(four))
        .where(F.col("held") == 4)
        .select("clip_id", "block", "power")
    )


def integrated_loudness(sub_blocks: DataFrame) -> DataFrame:
    """Gated loudness per clip: blocks over -70, then those within 10 of their mean."""
    blocks = gating_blocks(sub_blocks).withColumn("lufs", lufs(F.col("power")))
    loud = blocks.where(F.col("lufs") > k.ABSOLUTE_GATE_LUFS)
    gates = loud.groupBy("clip_id").agg((lufs(F.avg("power")) + k.RELATIVE_GATE_LU).alias("gate"))
    kept = loud.join(gates, "clip_id").where(F.col("lufs") > F.col("gate"))
    measured = kept.groupBy("clip_id").agg(lufs(F.avg("power")).alias("loudness"))
    return (
        sub_blocks.select("clip_id")
        .distinct()
        .join(measured, "clip_id", "left")
        .select("clip_id", F.coalesce("loudness", silence()).alias("loudness"))
    )


def sound_bounds(
    levels: DataFrame, sizes: DataFrame, block: int = 1024, pad: int = 4410
) -> DataFrame:
    """First to last block with sound, padded and clamped, in samples; silent clips are rejected.

    `levels` has (clip_id, block, power), `sizes` (clip_id, samples).
    """
    decibels = levels.withColumn("db", 10 * F.log10(F.col("power") + 1e-12))
    loudest = decibels.groupBy("clip_id").agg(F.max("db").alias("loudest"))
    floor = F.greatest(F.lit(k.SILENCE_FLOOR_DB), F.col("loudest") - k.EDGE_RANGE_DB)
    loud = F.when(F.col("db") > floor, F.col("block"))
    edges = (
        decibels.join(loudest, "clip_id")
        .groupBy("clip_id", "loudest")
        .agg(F.min(loud).alias("first"), F.max(loud).alias("last"))
    )
    silent = F.col("loudest") < k.SILENCE_FLOOR_DB
    return edges.join(sizes, "clip_id").select(
        "clip_id",
        silent.alias("silent"),
        F.when(~silent, F.greatest(F.lit(0), F.col("first") * block - pad)).alias("start"),
        F.when(~silent, F.least(F.col("samples"), (F.col("last") + 1) * block + pad)).alias("end"),
    )


def gains(loudness: DataFrame, peaks: DataFrame) -> DataFrame:
    """Gain to the target loudness, held down where the peak would pass the ceiling."""
    wanted = F.when(
        F.col("loudness") > silence(), F.pow(F.lit(10.0), (F.lit(k.TARGET_LUFS) - F.col("loudness")) / 20)
    ).otherwise(F.lit(1.0))
    return (
        loudness.join(peaks, "clip_id")
        .withColumn("wanted", wanted)
        .select(
            "clip_id",
            F.when(
                F.col("peak") * F.col("wanted") > k.PEAK_CEILING, F.lit(k.PEAK_CEILING) / F.col("peak")
            )
            .otherwise(F.col("wanted"))
            .alias("gain"),
        )
    )
