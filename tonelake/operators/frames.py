"""Frame curves: onset strength, peaks, note ends, window stitching, MIDI pairing, waveforms.

A curve has one row per (clip, frame, pitch); frames of a clip are bounded by its length, so a
window per (clip, pitch) is too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions import constants as k
from tonelake.operators import sliced


def _by_pitch() -> Window:
    return Window.partitionBy("clip_id", "pitch").orderBy("frame")


def onset_rises(curve: DataFrame, low: int, high: int) -> DataFrame:
    """Per frame the summed rises of the pitches in range (decimal sums: no order to depend on)."""
    inside = curve.where(F.col("pitch").between(low, high))
    rise = F.greatest(
        F.lit(0.0), F.col("value") - F.coalesce(F.lag("value").over(_by_pitch()), F.lit(0.0))
    )
    exact = F.bround(rise, 9).cast("decimal(18,9)")
    return (
        inside.withColumn("rise", exact)
        .groupBy("clip_id", "frame")
        .agg(F.sum("rise").cast("double").alias("rise"))
    )


def resample(series: DataFrame, rate: float) -> DataFrame:
    """A curve of (clip_id, frame, time_s, value) on an even grid from 0, linearly interpolated.

    Grid points meet the frame interval they fall in by (clip, second), so the join is an equi-join.
    """
    order = Window.partitionBy("clip_id").orderBy("frame")
    segments = (
        series.withColumn("t1", F.lead("time_s").over(order))
        .withColumn("v1", F.lead("value").over(order))
        .withColumnsRenamed({"time_s": "t0", "value": "v0"})
        .withColumn("end", F.coalesce("t1", F.col("t0") + 1.0))
        .withColumn(
            "second",
            F.explode(F.sequence(F.floor("t0"), F.floor("end"))),
        )
    )
    lengths = series.groupBy("clip_id").agg(F.max("time_s").alias("last_s"))
    grid = lengths.select(
        "clip_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("last_s") * rate).cast("int"))).alias("step")
    ).withColumn("at", F.col("step") / F.lit(rate))
    share = (F.col("at") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return (
        grid.withColumn("second", F.floor("at"))
        .join(segments, ["clip_id", "second"])
        .where((F.col("at") >= F.col("t0")) & (F.col("at") < F.col("end")))
        .select(
            "clip_id",
            "step",
            F.when(F.col("t1").isNull(), F.col("v0"))
            .otherwise(F.col("v0") + share * (F.col("v1") - F.col("v0")))
            .alias("value"),
        )
    )


def peaks(curve: DataFrame, threshold: float, neighbour: int) -> DataFrame:
    """Frames above the threshold with a climb before and a fall after, and their sub-frame shift."""
    w = _by_pitch()

    def at(offset: int) -> Column:
        return F.col("value") if offset == 0 else F.lag("value", -offset).over(w)

    around = curve.select(
        "clip_id", "pitch", "frame", *[at(i).alias(f"v{i + neighbour}") for i in range(-neighbour, neighbour + 1)]
    )
    centre = F.col(f"v{neighbour}")
    is_peak = centre > threshold
    for i in range(neighbour):
        is_peak &= F.col(f"v{neighbour - i}") >= F.col(f"v{neighbour - i - 1}")
        is_peak &= F.col(f"v{neighbour + i}") >= F.col(f"v{neighbour + i + 1}")
    before, after = F.col(f"v{neighbour - 1}"), F.col(f"v{neighbour + 1}")
    flat = centre - F.least(before, after)
    shift = F.when(flat == 0, F.lit(0.0)).otherwise((after - before) / flat / 2)
    return around.where(is_peak).select("clip_id", "pitch", "frame", shift.alias("shift"))


def decode_notes(
    onset: DataFrame, offset: DataFrame, frame: DataFrame, low: int, high: int
) -> DataFrame:
    """Notes from onset, offset and frame curves.

    A note runs to just before the next onset if it still sounds then; else to where its frame
    curve goes silent, or to an offset well before that; and never past the longest note.
    """
    marks = (
        frame.where(F.col("pitch").between(low, high))
        .join(
            peaks(onset, k.ONSET_THRESHOLD, 2).withColumnRenamed("shift", "onset_shift"),
            ["clip_id", "pitch", "frame"],
            "left",
        )
        .join(
            peaks(offset, k.OFFSET_THRESHOLD, 4).withColumnRenamed("shift", "offset_shift"),
            ["clip_id", "pitch", "frame"],
            "left",
        )
    )
    # walking backwards, the last marked frame seen so far is the first one after this frame
    back = (
        Window.partitionBy("clip_id", "pitch")
        .orderBy(F.desc("frame"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )

    def next_frame(mark: Column) -> Column:
        return F.last(F.when(mark, F.col("frame")), ignorenulls=True).over(back)

    whole = Window.partitionBy("clip_id", "pitch")
    silent = F.col("value") <= k.FRAME_THRESHOLD
    n = F.col("frames")
    found = (
        marks.withColumn("frames", F.max("frame").over(whole) + 1)
        .withColumn("following", F.coalesce(next_frame(F.col("onset_shift").isNotNull()), n))
        .withColumn("ended", F.coalesce(next_frame(F.col("offset_shift").isNotNull()), n))
        .withColumn("gone", F.coalesce(next_frame(silent), n))
        .where(F.col("onset_shift").isNotNull())
        .withColumn("limit", F.least(F.col("frame") + k.MAX_NOTE_FRAMES, n - 1))
    )
    repicked = F.col("following") <= F.least("gone", "limit")
    fades = F.col("gone") <= F.col("limit")
    close = (F.col("ended") <= F.col("gone")) & (
        F.col("ended") - F.col("frame") > F.col("gone") - F.col("ended")
    )
    end = (
        F.when(repicked, F.col("following") - 1)
        .when(fades, F.when(close, F.col("ended")).otherwise(F.col("gone")))
        .otherwise(F.col("limit"))
    )
    shifts = marks.where(F.col("offset_shift").isNotNull()).select(
        "clip_id", "pitch", F.col("frame").alias("end_frame"), F.col("offset_shift").alias("end_shift")
    )
    return (
        found.withColumn("end_frame", end)
        .withColumn("repicked", repicked)
        .join(shifts, ["clip_id", "pitch", "end_frame"], "left")
        .select(
            "clip_id",
            "pitch",
            "frame",
            "end_frame",
            ((F.col("frame") + F.col("onset_shift")) / k.FRAMES_PER_SECOND).alias("start_s"),
            (
                (
                    F.col("end_frame")
                    + F.when(F.col("repicked"), 0.0).otherwise(F.coalesce("end_shift", F.lit(0.0)))
                )
                / k.FRAMES_PER_SECOND
            ).alias("end_s"),
        )
    )


def window_plan(
    lengths: DataFrame, chunk: int = k.CHUNK_FRAMES, border: int = k.BORDER_FRAMES
) -> DataFrame:
    """Overlapping model windows of each clip and the frames each keeps.

    Windows overlap by two borders; each keeps from the middle of its overlap on, and the last one
    ends at the end of the clip. `lengths` has (clip_id, n_frames).
    """
    step = chunk - 2 * border
    n = F.col("n_frames")
    regular = F.when(
        n > chunk, F.sequence(F.lit(0), n - chunk - 1, F.lit(step).cast("bigint"))
    ).otherwise(F.array().cast("array<bigint>"))
    starts = F.concat(regular, F.array(F.greatest(n - chunk, F.lit(0))))
    windows = lengths.withColumn("starts", starts).select(
        "clip_id", "n_frames", "starts", F.posexplode("starts").alias("window", "start")
    )
    following = F.try_element_at(F.col("starts"), F.col("window") + 2)
    return windows.select(
        "clip_id",
        "window",
        "start",
        F.when(F.col("window") == 0, F.lit(0)).otherwise(F.col("start") + border).alias("keep_from"),
        F.coalesce(following + border, n).alias("keep_to"),
    )


def stitch(window_rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Frames of all windows joined into one curve: each window's kept middle."""
    return (
        window_rows.join(plan, ["clip_id", "window"])
        .where((F.col("frame") >= F.col("keep_from")) & (F.col("frame") < F.col("keep_to")))
        .select(*window_rows.columns)
    )


def pair_notes(events: DataFrame) -> DataFrame:
    """Notes from start and stop events with delta times.

    `events` has (clip_id, seq, delta, channel, pitch, velocity, is_on). A start with velocity 0
    is a stop; a new start replaces an open one; a stop with nothing open is dropped.
    """
    slice_ = F.expr("seq div 4096")
    timed = sliced.running_sum(events, ["clip_id"], slice_, ["seq"], "delta", "now").withColumn(
        "starts", F.col("is_on") & (F.col("velocity") > 0)
    )
    paired = sliced.previous(
        timed,
        ["clip_id", "channel", "pitch"],
        slice_,
        ["seq"],
        {"starts": "open", "now": "opened"},
    )
    return paired.where(~F.col("starts") & F.coalesce("open", F.lit(False))).select(
        "clip_id",
        "seq",
        "channel",
        "pitch",
        F.col("opened").alias("onset"),
        F.col("now").alias("offset"),
        (F.col("channel") + 1).alias("string"),
    )


def waveform(levels: DataFrame, count: int) -> DataFrame:
    """Each clip's levels in `count` equal slices, the loudest of each; short clips pass through.

    `levels` has (clip_id, position, level), positions from 0. Slice i covers positions from
    floor(i·n/count) up to floor((i+1)·n/count).
    """
    sizes = levels.groupBy("clip_id").agg((F.max("position") + 1).alias("n"))
    slot = F.when(F.col("n") <= count, F.col("position")).otherwise(
        F.expr(f"((position + 1) * {count} - 1) div n")
    )
    return (
        levels.join(sizes, "clip_id")
        .groupBy("clip_id", slot.alias("slot"))
        .agg(F.max("level").alias("level"))
    )


def latency(energies: DataFrame, hop_s: float) -> DataFrame:
    """Per clip how late its notes are: the median of each note's best lag, in seconds.

    `energies` has (clip_id, note_idx, lag, energy); the lowest lag wins a tie. Best lags take few
    distinct values, so they are counted before the median is taken.
    """
    best = energies.groupBy("clip_id", "note_idx").agg(
        F.max_by("lag", F.struct("energy", -F.col("lag"))).alias("lag")
    )
    counted = best.groupBy("clip_id", "lag").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("clip_id").agg(
        (-F.percentile("lag", F.lit(0.5), F.col("n")) * hop_s).alias("latency_s")
    )
