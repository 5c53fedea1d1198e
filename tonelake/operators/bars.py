"""Bars of a score: lines, start times, voices with rests, pieces per bar, pace, regridding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions.constants import BEATS_PER_BAR
from tonelake.operators import timeline

BAR12 = BEATS_PER_BAR * 12


def score_ends(score: DataFrame, numbers: DataFrame) -> DataFrame:
    """Per clip: the last note's end (twelfths), the first bar line after 0, and the bar count."""
    ends = score.groupBy("clip_id").agg(F.max(F.col("onset12") + F.col("duration12")).alias("end12"))
    first = F.when(F.col("pickup") > 0, F.col("pickup")).otherwise(BEATS_PER_BAR) * 12
    return (
        ends.join(numbers, "clip_id")
        .withColumn("first12", first.cast("bigint"))
        .withColumn(
            "full_bars",
            F.ceil(F.greatest(F.lit(0), F.col("end12") - F.col("first12")) / BAR12).cast("bigint"),
        )
    )


def bar_lines(ends: DataFrame) -> DataFrame:
    """Bars of each clip: (bar, start12, end12); the first is the pickup if there is one."""
    bars = F.expr("sequence(0L, full_bars)")
    start = F.when(F.col("bar") == 0, F.lit(0)).otherwise(
        F.col("first12") + (F.col("bar") - 1) * BAR12
    )
    return ends.select("clip_id", "origin", "first12", F.explode(bars).alias("bar")).select(
        "clip_id",
        "origin",
        "bar",
        start.cast("bigint").alias("start12"),
        (F.col("first12") + F.col("bar") * BAR12).alias("end12"),
    )


def bar_starts(bars: DataFrame, spans: DataFrame, trims: DataFrame) -> DataFrame:
    """When each bar starts in the uploaded recording, in milliseconds.

    `trims` has (clip_id, trim): the ticks cut off the front before transcription.
    """
    timed = timeline.to_ticks(bars, spans, F.col("start12") / 12 + F.col("origin"), "tick")
    return timed.join(trims, "clip_id").select(
        "clip_id",
        "bar",
        (F.col("end12") - F.col("start12")).alias("length12"),
        F.bround((F.col("tick") + F.col("trim")) / 10).cast("bigint").alias("start_ms"),
    )


def bar_paces(starts: DataFrame) -> DataFrame:
    """Tempo each bar was played at; a bar without a later start keeps the pace before it."""
    order = Window.partitionBy("clip_id").orderBy("bar")
    width = F.lead("start_ms").over(order) - F.col("start_ms")
    own = F.when(width > 0, (F.col("length12") / 12) * 60_000 / width)
    return starts.withColumn("own", own).select(
        "clip_id",
        "bar",
        F.last("own", ignorenulls=True)
        .over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        .alias("bpm"),
    )


def voice(score: DataFrame, ends: DataFrame) -> DataFrame:
    """One voice per clip: a chord lasts until it ends or the next starts; rests fill the gaps.

    Rows are (start12, end12, pitches); a rest has no pitches. Only distinct onsets are ordered,
    and those are bounded by the clip's length.
    """
    chords = score.groupBy("clip_id", "onset12").agg(
        F.array_sort(F.collect_set("pitch")).alias("pitches"),
        F.max(F.col("onset12") + F.col("duration12")).alias("stop12"),
    )
    order = Window.partitionBy("clip_id").orderBy("onset12")
    following, free_from = F.lead("onset12").over(order), F.coalesce(F.lag("stop12").over(order), F.lit(0))
    played = chords.select(
        "*",
        F.least("stop12", following).alias("end12"),
        free_from.alias("free_from"),
        following.isNull().alias("is_last"),
    )
    close = (F.col("first12") + F.col("full_bars") * BAR12).alias("close12")

    def event(start: str, end: str, pitches: Column) -> Column:
        return F.struct(F.col(start).alias("start12"), F.col(end).alias("end12"), pitches.alias("pitches"))

    none = F.array().cast("array<bigint>")
    events = F.array(
        F.when(F.col("onset12") > F.col("free_from"), event("free_from", "onset12", none)),
        event("onset12", "end12", F.col("pitches")),
        F.when(F.col("is_last") & (F.col("end12") < F.col("close12")), event("end12", "close12", none)),
    )
    # one pass for notes and rests: a chord's row tells the rest before it, and the last one's that after it
    return played.join(ends.select("clip_id", close), "clip_id", "left").select(
        "clip_id", F.inline(F.array_compact(events))
    )


def boundaries(events: DataFrame) -> DataFrame:
    """Every start and end of the events, once."""
    return (
        events.select("clip_id", F.col("start12").alias("point12"))
        .union(events.select("clip_id", F.col("end12").alias("point12")))
        .distinct()
    )


def regrid(events: DataFrame) -> DataFrame:
    """Give each beat one grid: thirds if all its inner boundaries are thirds, else sixteenths."""
    # a boundary seen twice says nothing new, so they are not made distinct first
    points = events.select("clip_id", F.explode(F.array("start12", "end12")).alias("point12"))
    inner = points.where(F.pmod("point12", F.lit(12)) != 0)
    thirds = inner.groupBy("clip_id", F.expr("floor(point12 / 12)").alias("beat")).agg(
        F.bool_and(F.pmod("point12", F.lit(4)) == 0).alias("thirds")
    )

    def moved(point: str, flag: str) -> Column:
        beat = F.floor(F.col(point) / 12)
        part = F.col(point) - beat * 12
        lines = F.when(F.col(flag), 3).otherwise(4)
        return F.when(part == 0, F.col(point)).otherwise(
            beat * 12 + (F.rint(part * lines / 12) * 12 / lines).cast("bigint")
        )

    def side(name: str) -> DataFrame:
        return thirds.withColumnsRenamed({"beat": f"{name}_beat", "thirds": f"{name}_thirds"})

    joined = (
        events.withColumn("start_beat", F.floor(F.col("start12") / 12))
        .withColumn("end_beat", F.floor(F.col("end12") / 12))
        .join(side("start"), ["clip_id", "start_beat"], "left")
        .join(side("end"), ["clip_id", "end_beat"], "left")
    )
    kept = [c for c in events.columns if c not in ("start12", "end12")]
    return joined.select(
        *kept,
        moved("start12", "start_thirds").alias("start12"),
        moved("end12", "end_thirds").alias("end12"),
    ).where(F.col("start12") < F.col("end12"))


def bar_pieces(events: DataFrame, ends: DataFrame) -> DataFrame:
    """Events cut at bar lines, with tie flags. Bars are regular, so no join finds them."""

    def bar_of(point: Column) -> Column:
        later = F.floor((point - F.col("first12")) / BAR12) + 1
        return F.when(point < F.col("first12"), F.lit(0)).otherwise(later).cast("bigint")

    spread = events.join(ends.select("clip_id", "first12"), "clip_id").withColumn(
        "bar", F.explode(F.sequence(bar_of(F.col("start12")), bar_of(F.col("end12") - 1)))
    )
    bar_end = F.col("first12") + F.col("bar") * BAR12
    bar_start = F.when(F.col("bar") == 0, F.lit(0)).otherwise(bar_end - BAR12)
    from12, to12 = F.greatest("start12", bar_start), F.least("end12", bar_end)
    sounding = F.size("pitches") > 0
    return spread.select(
        "clip_id",
        "bar",
        from12.alias("from12"),
        to12.alias("to12"),
        F.array_join(F.col("pitches").cast("array<string>"), ",").alias("pitches"),
        (sounding & (to12 < F.col("end12"))).alias("tie_start"),
        (sounding & (from12 > F.col("start12"))).alias("tie_stop"),
    )
