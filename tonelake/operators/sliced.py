"""Running sums and previous rows over long groups, in two levels.

A group is cut into slices by a column that follows its order. Rows are ordered inside their
slice only; one row per slice is ordered across the group. A group with a third of all rows is
then as many small sorts, and what is left for one task is one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(
    df: DataFrame, keys: list[str], slice_: Column, order: list[str], value: str, out: str
) -> DataFrame:
    sliced = df.withColumn("_slice", slice_)
    inside = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum(value).alias("_sum"))
        .select(*keys, "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carry"))
    )
    return (
        sliced.withColumn("_local", F.sum(value).over(inside))
        .join(carried, [*keys, "_slice"])
        .select(*df.columns, (F.col("_carry") + F.col("_local")).alias(out))
    )


def previous(
    df: DataFrame, keys: list[str], slice_: Column, order: list[str], values: dict[str, str]
) -> DataFrame:
    """Adds, for each `value -> out`, the value in the row before this one in its group."""
    sliced = df.withColumn("_slice", slice_)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_slice")
    closing = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last"))
        .select(*keys, "_slice", F.lag("_last").over(across).alias("_before"))
    )
    return (
        sliced.withColumn("_here", F.lag(F.struct(*values)).over(inside))
        .join(closing, [*keys, "_slice"])
        .withColumn("_previous", F.coalesce("_here", "_before"))
        .select(*df.columns, *[F.col(f"_previous.{v}").alias(o) for v, o in values.items()])
    )
