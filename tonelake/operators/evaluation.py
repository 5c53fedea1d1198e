"""Scores of found notes, beats, positions, chords and strings against annotations; gates, tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonelake.functions import constants as k
from tonelake.operators import matching
from tonelake.operators.folds import sorted_fold
from tonelake.operators.rhythm import islands, ticks

PITCHED = ["clip_id", "pitch"]


def note_matches(truth: DataFrame, found: DataFrame) -> DataFrame:
    return matching.match_times(truth, found, PITCHED, "onset", matching.ONSET_TOLERANCE)


def note_pairs(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(clip_id, pitch, truth_id, found_id) of notes with the same pitch and near onsets."""
    segments = note_matches(truth, found)
    return matching.matched_pairs(segments, truth, found, PITCHED, "onset", "note_idx")


def note_scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Precision, recall and F1 of notes, and F1 when offsets must agree too."""
    n = F.count(F.lit(1))
    sizes = (
        truth.groupBy("clip_id")
        .agg(n.alias("truths"))
        .join(found.groupBy("clip_id").agg(n.alias("founds")), "clip_id", "full_outer")
        .na.fill(0, ["truths", "founds"])
    )
    plain = matching.matched_counts(note_matches(truth, found), ["clip_id"])
    strict = matching.matched_with_offsets(truth, found).withColumnRenamed("matched", "whole")
    joined = sizes.join(plain, "clip_id", "left").join(strict, "clip_id", "left").na.fill(0)
    truths, founds = F.col("truths"), F.col("founds")
    precision, recall, f1 = matching.prf(F.col("matched"), truths, founds)
    return joined.select(
        "clip_id",
        precision.alias("note_precision"),
        recall.alias("note_recall"),
        f1.alias("note_f1"),
        matching.prf(F.col("whole"), truths, founds)[2].alias("note_f1_with_offsets"),
    )


def beat_scores(truth: DataFrame, found: DataFrame, name: str, trim_s: float = 0.0) -> DataFrame:
    """F-measure of beat times within 70 ms, leaving out the first `trim_s` seconds."""
    kept_truth, kept_found = truth, found
    if trim_s:
        kept_truth = truth.where(F.col("tick") >= ticks(trim_s))
        kept_found = found.where(F.col("tick") >= ticks(trim_s))
    segments = matching.match_times(
        kept_truth, kept_found, ["clip_id"], "tick", ticks(k.BEAT_TOLERANCE_S)
    )
    n = F.count(F.lit(1))
    joined = (
        truth.select("clip_id")
        .distinct()
        .join(kept_truth.groupBy("clip_id").agg(n.alias("truths")), "clip_id", "left")
        .join(kept_found.groupBy("clip_id").agg(n.alias("founds")), "clip_id", "left")
        .join(matching.matched_counts(segments, ["clip_id"]), "clip_id", "left")
        .na.fill(0)
    )
    f1 = matching.prf(F.col("matched"), F.col("truths"), F.col("founds"))[2]
    return joined.select("clip_id", f1.alias(name))


def tempo_correct(truth: DataFrame, found: DataFrame) -> DataFrame:
    """1 where the found tempo is within 4 % of the annotated one, else 0."""
    near = F.abs(F.col("found_bpm") / F.col("truth_bpm") - 1) <= k.TEMPO_TOLERANCE
    return (
        truth.select("clip_id", F.col("tempo_bpm").alias("truth_bpm"))
        .join(found.select("clip_id", F.col("tempo_bpm").alias("found_bpm")), "clip_id")
        .select("clip_id", near.cast("double").alias("tempo_correct"))
    )


def _off(a: Column, b: Column, cycle: int) -> Column:
    distance = F.abs(a - b) % cycle
    return F.least(distance, cycle - distance) > k.POSITION_TOLERANCE_BEATS


def position_scores(pairs: DataFrame) -> DataFrame:
    """Share of matched notes written at the right place in the beat, and in the bar.

    `pairs` has (clip_id, truth_beat, written_beat), both counted from a bar line.
    """

    def ok(cycle: int) -> Column:
        return F.when(_off(F.col("truth_beat"), F.col("written_beat"), cycle), 0).otherwise(1)

    return pairs.groupBy("clip_id").agg(
        (F.sum(ok(1)) / F.count(F.lit(1))).alias("notes_on_beat"),
        (F.sum(ok(k.BEATS_PER_BAR)) / F.count(F.lit(1))).alias("notes_in_bar"),
    )


# --- the player's chords ---


def played_events(truth: DataFrame) -> DataFrame:
    """Annotated notes grouped into the player's events: (clip_id, note_idx, onset, pitch, event).

    Onsets chained closely, over a limited span, each pitch once; an event is named by its first
    note. Repeats of one (onset, pitch) are folded to their first and last note before the walk;
    each repeat in between is an event by itself.
    """
    gap, span = ticks(k.TRUTH_STRUM_GAP_S), ticks(k.TRUTH_STRUM_SPAN_S)
    strikes = truth.groupBy("clip_id", "onset", "pitch").agg(
        F.min("note_idx").alias("first_idx"), F.max("note_idx").alias("last_idx")
    )
    stretches = islands(
        strikes.select("clip_id", "onset").distinct(), ["clip_id"], "onset", gap, "stretch"
    )
    rows = strikes.join(stretches, ["clip_id", "onset"]).select(
        "clip_id", "stretch", "onset", "pitch", "first_idx", "last_idx"
    )

    def step(state, row):
        _, _, onset, pitch, first_idx, last_idx = row
        joins = False
        if state is not None:
            opened, name, pitches, last = state
            joins = onset - last <= gap and onset - opened <= span and pitch not in pitches
        if joins:
            pitches.add(pitch)
        else:
            opened, name, pitches = onset, first_idx, {pitch}
        event = name
        if last_idx != first_idx:
            opened, name, pitches = onset, last_idx, {pitch}
        return (opened, name, pitches, onset), (event,)

    walked = sorted_fold(
        rows, ["clip_id", "stretch"], ["onset", "pitch"], step, "first_event bigint"
    )
    event = F.when(F.col("note_idx") == F.col("first_idx"), F.col("first_event")).otherwise(
        F.col("note_idx")
    )
    named = walked.select("clip_id", "onset", "pitch", "first_idx", "first_event")
    return truth.join(named, ["clip_id", "onset", "pitch"]).select(
        "clip_id", "note_idx", "onset", "pitch", event.alias("event")
    )


def grouping_scores(events: DataFrame, written: DataFrame) -> DataFrame:
    """Whether the score keeps the player's chords together and separate notes apart.

    `written` has (clip_id, note_idx, onset12): where each annotated note that was found is
    written. Notes repeated at one instant form events of their own between two others at no
    distance, so they can never be neighbours that count; the newest and oldest of them stay.
    """
    per_event = (
        events.join(written, ["clip_id", "note_idx"], "left")
        .groupBy("clip_id", "event")
        .agg(
            F.count(F.lit(1)).alias("notes"),
            F.count("onset12").alias("found"),
            F.collect_set("onset12").alias("positions"),
            F.min("onset").alias("first"),
            F.max("onset").alias("last"),
            F.max(F.when(F.col("note_idx") == F.col("event"), F.col("pitch"))).alias("opened_at"),
        )
        # events follow one another as their first notes do
        .withColumn("place", F.struct("first", "opened_at", "event"))
    )
    strums = per_event.where(
        (F.col("notes") >= k.STRUM_MIN_NOTES) & (F.col("found") >= 2)
    ).groupBy("clip_id").agg(
        (F.count_if(F.size("positions") == 1) / F.count(F.lit(1))).alias("chords_whole")
    )
    # of the events at one instant only the outer two can have a neighbour at a distance
    instant = Window.partitionBy("clip_id", "first")
    inner = (
        (F.col("first") == F.col("last"))
        & (F.col("place") != F.min("place").over(instant))
        & (F.col("place") != F.max("place").over(instant))
    )
    lean = per_event.withColumn("inner", inner).where(~F.col("inner"))
    order = Window.partitionBy("clip_id").orderBy("place")
    neighbours = (
        lean.withColumn("next_first", F.lead("first").over(order))
        .withColumn("next_positions", F.lead("positions").over(order))
        .where(
            (F.size("positions") > 0)
            & (F.coalesce(F.size("next_positions"), F.lit(0)) > 0)
            & (F.col("next_first") - F.col("last") >= ticks(k.SEPARATE_S))
        )
        .groupBy("clip_id")
        .agg(
            (
                F.count_if(~F.arrays_overlap("positions", "next_positions")) / F.count(F.lit(1))
            ).alias("notes_apart")
        )
    )
    clips = events.select("clip_id").distinct()
    return clips.join(strums, "clip_id", "left").join(neighbours, "clip_id", "left")


def string_accuracy(truth: DataFrame, placed: DataFrame) -> DataFrame:
    """Of the placed notes that match an annotated one, the share on the player's string."""
    pairs = note_pairs(truth, placed)
    own = truth.select("clip_id", F.col("note_idx").alias("truth_id"), F.col("string").alias("own"))
    given = placed.select(
        "clip_id", F.col("note_idx").alias("found_id"), F.col("string").alias("given")
    )
    judged = (
        pairs.join(own, ["clip_id", "truth_id"])
        .join(given, ["clip_id", "found_id"])
        .groupBy("clip_id")
        .agg((F.count_if(F.col("own") == F.col("given")) / F.count(F.lit(1))).alias("accuracy"))
    )
    return (
        truth.select("clip_id")
        .distinct()
        .join(judged, "clip_id", "left")
        .select("clip_id", F.coalesce("accuracy", F.lit(0.0)).alias("tab_string_accuracy"))
    )


# --- metric tables ---


def to_long(scores: DataFrame, key: str = "clip_id") -> DataFrame:
    """(key, metric, value) rows of the metrics each clip has."""
    metrics = [c for c in scores.columns if c != key]
    return scores.unpivot([key], metrics, "metric", "value").where(F.col("value").isNotNull())


def suite_means(metrics: DataFrame) -> DataFrame:
    """Mean of each metric over the clips of a suite that have it."""
    exact = F.bround("value", 9).cast("decimal(28,9)")
    return metrics.groupBy("suite", "metric").agg(
        F.bround((F.sum(exact) / F.count(F.lit(1))).cast("double"), 4).alias("mean"),
        F.count(F.lit(1)).alias("clips"),
    )


def regressions(
    metrics: DataFrame, baseline: DataFrame, tolerance: float = k.METRIC_TOLERANCE
) -> DataFrame:
    """Metrics that fell below their baseline by more than the tolerance."""
    kept = baseline.select("clip_id", "metric", F.col("value").alias("expected"))
    return (
        metrics.join(kept, ["clip_id", "metric"])
        .where(F.col("value") < F.col("expected") - F.lit(tolerance))
        .select("clip_id", "metric", "value", "expected")
    )


def report(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row per clip, a text column per metric, blank where the clip lacks it."""
    cells = metrics.groupBy("clip_id").agg(
        *[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names]
    )
    return cells.select(
        "clip_id",
        *[
            F.when(F.col(n).isNull(), "").otherwise(F.format_string("%.3f", F.bround(n, 3))).alias(n)
            for n in names
        ],
    )


def report_with_means(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(kind, name, one text column per metric): a row for each clip, then the means of each suite.

    `metrics` has (clip_id, suite, metric, value). A mean covers the clips that have the metric.
    """
    clips = report(metrics, names).select(F.lit("clip").alias("kind"), F.col("clip_id").cast("string").alias("name"), *names)
    means = suite_means(metrics).select(F.col("suite").alias("clip_id"), "metric", F.col("mean").alias("value"))
    means = report(means, names).select(F.lit("mean").alias("kind"), F.col("clip_id").alias("name"), *names)
    return clips.unionByName(means)


def write_report(rows: DataFrame, path: str) -> None:
    """The report as CSV with a header, clips before means, each by name."""
    rows.repartitionByRange("kind", "name").sortWithinPartitions("kind", "name").write.option("header", True).csv(path)


BASELINE = "pipeline_version string, tolerance double, kind string, name string, metrics map<string,double>"


def baseline_rows(metrics: DataFrame, version: str, tolerance: float) -> DataFrame:
    """What a baseline file holds: every clip's metrics and every suite's means, with the version that
    made them and the drop that is allowed against them."""
    means = suite_means(metrics)
    long = metrics.select(F.lit("clip").alias("kind"), F.col("clip_id").cast("string").alias("name"), "metric", "value")
    long = long.unionByName(means.select(F.lit("mean").alias("kind"), F.col("suite").alias("name"), "metric", F.col("mean").alias("value")))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics")
    head = (F.lit(version).alias("pipeline_version"), F.lit(float(tolerance)).alias("tolerance"))
    return long.groupBy("kind", "name").agg(entries).select(*head, "kind", "name", "metrics")


def write_baseline(rows: DataFrame, path: str) -> None:
    """JSON lines in the order of kind and name, metrics by name: equal results give equal files."""
    rows.repartitionByRange("kind", "name").sortWithinPartitions("kind", "name").write.json(path)


def read_baseline_file(spark: SparkSession, path: str) -> DataFrame:
    """(pipeline_version, tolerance, kind, name, metric, value) of a written baseline."""
    rows = spark.read.schema(BASELINE).json(path)
    return rows.select("pipeline_version", "tolerance", "kind", "name", F.explode("metrics").alias("metric", "value"))


def gate(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """Clips' metrics that fell below a read baseline by more than its own tolerance."""
    kept = baseline.where("kind = 'clip'").select("name", "metric", F.col("value").alias("expected"), "tolerance")
    now = metrics.withColumn("name", F.col("clip_id").cast("string"))
    return (
        now.join(kept, ["name", "metric"])
        .where(F.col("value") < F.col("expected") - F.col("tolerance"))
        .select("clip_id", "metric", "value", "expected")
    )


def baseline_documents(metrics: DataFrame) -> DataFrame:
    """Each clip's metrics as one JSON object with sorted names: at most a dozen entries."""
    entries = F.array_sort(F.collect_list(F.struct("metric", "value")))
    return metrics.groupBy("clip_id").agg(F.to_json(F.map_from_entries(entries)).alias("body"))


def read_baseline(documents: DataFrame) -> DataFrame:
    parsed = documents.select("clip_id", F.from_json("body", "map<string,double>").alias("m"))
    return parsed.select("clip_id", F.explode("m").alias("metric", "value"))


# --- tuning ---


def with_candidates(rows: DataFrame, candidates: list[tuple[str, float]]) -> DataFrame:
    """Every row once per candidate setting; the settings are a short fixed list."""
    settings = F.array(
        *[F.struct(F.lit(n).alias("setting"), F.lit(float(v)).alias("parameter")) for n, v in candidates]
    )
    return rows.select("*", F.inline(settings))


def setting_means(scores: DataFrame) -> DataFrame:
    """Mean score of each setting with both modes weighing the same.

    `scores` has (setting, mode, score).
    """
    exact = F.bround("score", 9).cast("decimal(28,9)")
    by_mode = scores.groupBy("setting", "mode").agg(
        (F.sum(exact) / F.count(F.lit(1))).cast("double").alias("mean")
    )
    comp = F.max(F.when(F.col("mode") == "comp", F.col("mean")))
    solo = F.max(F.when(F.col("mode") == "solo", F.col("mean")))
    return by_mode.groupBy("setting").agg(
        F.round((comp + solo) / 2, 6).alias("mean"),
        F.round(comp, 6).alias("comp"),
        F.round(solo, 6).alias("solo"),
    )


def best_settings(means: DataFrame, today: float, max_loss: float, n: int = 10) -> DataFrame:
    """The best settings among those that lose at most `max_loss` on solos against today's."""
    allowed = means.where(F.col("solo") >= F.lit(today) - F.lit(max_loss))
    return allowed.orderBy(F.desc("mean"), "setting").limit(n)
