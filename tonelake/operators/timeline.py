"""Beat maps: seconds to beats and back, and joins of points and intervals inside a clip.

A clip's range joins are equi-joins on (clip, time slice) with the range test left over, so a long
or busy clip is spread over its slices and AQE can split a slice that is still too big.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = 10_000  # ticks: one second


def beat_spans(beats: DataFrame) -> DataFrame:
    """Intervals between consecutive beats: (clip_id, beat, t0, t1, is_first, is_last).

    Beats of a clip are bounded by its length (a few per second), never by its notes.
    """
    order = Window.partitionBy("clip_id").orderBy("beat")
    return (
        beats.select("clip_id", "beat", F.col("tick").alias("t0"))
        .withColumn("t1", F.lead("t0").over(order))
        .withColumn("is_first", F.lag("t0").over(order).isNull())
        .withColumn("is_last", F.lead("t0", 2).over(order).isNull())
        .where(F.col("t1").isNotNull())
    )


def reach_of(notes: DataFrame) -> DataFrame:
    """The last moment any note of the clip touches: one row per clip, map-side combined."""
    return notes.groupBy("clip_id").agg(F.max("offset").alias("reach"))


def sliced_spans(spans: DataFrame, reach: DataFrame) -> DataFrame:
    """Beat intervals repeated for each slice they touch; the outer two are open-ended."""
    return (
        spans.join(reach, "clip_id")
        .withColumn("low", F.when(F.col("is_first"), F.least(F.lit(0), F.col("t0"))).otherwise(F.col("t0")))
        .withColumn(
            "high",
            F.when(F.col("is_last"), F.greatest(F.col("reach") + 1, F.col("t1"))).otherwise(F.col("t1")),
        )
        .withColumn("slice", F.explode(F.expr(f"sequence(low div {SLICE}, (high - 1) div {SLICE})")))
        .drop("reach")
    )


def fractional_beat(time: Column) -> Column:
    """Beat position of `time` in its interval; past the last beat the last interval goes on."""
    width = F.col("t1") - F.col("t0")
    inside = F.col("beat") + (time - F.col("t0")) / width
    return F.when(time >= F.col("t1"), F.col("beat") + 1 + (time - F.col("t1")) / width).otherwise(
        inside
    )


def to_beats(points: DataFrame, sliced: DataFrame, time: str, out: str) -> DataFrame:
    """Adds the fractional beat of `time` and the length of its beat (`<out>_span`)."""
    placed = points.withColumn("slice", F.expr(f"{time} div {SLICE}"))
    t = F.col(time)
    return (
        placed.join(sliced, ["clip_id", "slice"])
        .where((t >= F.col("low")) & (t < F.col("high")))
        .select(
            *points.columns,
            fractional_beat(t).alias(out),
            (F.col("t1") - F.col("t0")).alias(f"{out}_span"),
        )
    )


def to_ticks(positions: DataFrame, spans: DataFrame, beat: Column, out: str) -> DataFrame:
    """Adds the time (in ticks, fractional) of a beat position, going on past both ends.

    An equi-join on (clip, whole beat): positions outside the tracked beats use the edge interval.
    """
    edges = spans.groupBy("clip_id").agg(F.min("beat").alias("first"), F.max("beat").alias("last"))
    b = F.col("_beat")
    return (
        positions.withColumn("_beat", beat)
        .join(edges, "clip_id")
        .withColumn(
            "beat", F.greatest(F.least(F.floor(b), F.col("last")), F.col("first")).cast("bigint")
        )
        .join(spans.select("clip_id", "beat", "t0", "t1"), ["clip_id", "beat"])
        .select(
            *positions.columns,
            F.when(
                b >= F.col("last") + 1,
                F.col("t1") + (b - F.col("beat") - 1) * (F.col("t1") - F.col("t0")),
            )
            .otherwise(F.col("t0") + (b - F.col("beat")) * (F.col("t1") - F.col("t0")))
            .alias(out),
        )
    )


def overlaps(
    left: DataFrame, right: DataFrame, start: str = "start", end: str = "end", slice_: int = 2 * SLICE
) -> DataFrame:
    """Pairs of overlapping intervals of one clip with the shared part (`from_t`, `to_t`).

    Both sides have (clip_id, start, end, label). Intervals are repeated per slice they touch and
    a pair is kept only in the slice where its shared part begins, so it comes out once.
    """

    def spread(df: DataFrame, side: str) -> DataFrame:
        touched = F.expr(f"sequence(`{start}` div {slice_}, (`{end}` - 1) div {slice_})")
        return df.where(F.col(end) > F.col(start)).select(
            "clip_id",
            F.col(start).alias(f"{side}_start"),
            F.col(end).alias(f"{side}_end"),
            F.col("label").alias(f"{side}_label"),
            F.explode(touched).alias("slice"),
        )

    from_t = F.greatest("left_start", "right_start")
    to_t = F.least("left_end", "right_end")
    return (
        spread(left, "left")
        .join(spread(right, "right"), ["clip_id", "slice"])
        .where((from_t < to_t) & (F.floor(from_t / slice_) == F.col("slice")))
        .select("clip_id", "left_label", "right_label", from_t.alias("from_t"), to_t.alias("to_t"))
    )


def tempo(beats: DataFrame) -> DataFrame:
    """Tempo of each clip from its median beat interval."""
    widths = beat_spans(beats).select("clip_id", (F.col("t1") - F.col("t0")).alias("width"))
    return widths.groupBy("clip_id").agg(
        (F.lit(60.0) / (F.percentile("width", F.lit(0.5)) / 10_000.0)).alias("tempo_bpm")
    )


def recording_end(durations: DataFrame, sliced: DataFrame) -> DataFrame:
    """The end of each recording in 48ths of a beat; `durations` has (clip_id, end_tick)."""
    placed = to_beats(durations, sliced, "end_tick", "end_beat")
    return placed.select(
        "clip_id",
        F.bround(F.greatest(F.col("end_beat"), F.lit(0.0)) * 48).cast("bigint").alias("end48"),
    )
