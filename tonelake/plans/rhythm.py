"""Rhythm queries: rolls, strums, beat maps, grids, snapping, durations, downbeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.operators import rhythm as ops
from tonelake.operators import timeline
from tonelake.plans.registry import query
from tonelake.plans.role_sql import _CTES, add_role, with_roles
from tonelake.sources.roles import Roles

# --- shared oracle expressions: each rule replayed note by note, as the definition reads ---

add_role(
    "roll_walk",
    "notes",
    """SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY onset) AS i
       FROM (SELECT DISTINCT clip_id, onset FROM notes)""",
)
add_role(
    "rolls",
    "roll_walk",
    """SELECT clip_id, i, onset, onset AS roll_start FROM roll_walk WHERE i = 1
       UNION ALL SELECT n.clip_id, n.i, n.onset,
         CASE WHEN n.onset - r.onset > 350 OR n.onset - r.roll_start > 1000 THEN n.onset
           ELSE r.roll_start END
       FROM rolls r JOIN roll_walk n ON n.clip_id = r.clip_id AND n.i = r.i + 1""",
)
add_role(
    "ordered_notes",
    "notes",
    """SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY onset, pitch, note_idx) AS i
       FROM notes""",
)
add_role(
    "grouped",
    "ordered_notes",
    """SELECT clip_id, i, note_idx, onset, "offset", pitch, velocity, onset AS start,
         onset * 1000 + pitch * 2 AS chord, [pitch] AS pitches, 0 AS direction, 0 AS rise,
         0 AS fall
       FROM ordered_notes WHERE i = 1
       UNION ALL
       SELECT clip_id, i, note_idx, onset, "offset", pitch, velocity,
         CASE WHEN joins THEN p_start ELSE onset END, CASE WHEN joins THEN p_chord
           ELSE onset * 1000 + pitch * 2 + CASE WHEN apart = 0 AND move = 0 THEN 1 ELSE 0 END END,
         CASE WHEN joins THEN list_append(p_pitches, pitch) ELSE [pitch] END,
         CASE WHEN NOT joins THEN 0 WHEN steers AND p_direction = 0 THEN move ELSE p_direction END,
         CASE WHEN joins AND steers AND move > 0 THEN 1 ELSE 0 END,
         CASE WHEN joins AND steers AND move < 0 THEN 1 ELSE 0 END
       FROM (SELECT *, (apart <= 350 AND width <= 1000) OR (apart <= 1200 AND width <= 2000
             AND NOT list_contains(p_pitches, pitch) AND p_offset >= onset + 1000
             AND NOT (steers AND p_direction <> 0 AND move <> p_direction)) AS joins
         FROM (SELECT *, apart > 80 AND move <> 0 AS steers
           FROM (SELECT n.*, n.onset - g.onset AS apart, n.onset - g.start AS width,
               CASE WHEN n.pitch > g.pitch THEN 1 WHEN n.pitch < g.pitch THEN -1 ELSE 0 END AS move,
               g.start AS p_start, g.chord AS p_chord, g.pitches AS p_pitches,
               g.direction AS p_direction, g."offset" AS p_offset
             FROM grouped g JOIN ordered_notes n ON n.clip_id = g.clip_id AND n.i = g.i + 1)))""",
)


def _beat_of(alias: str, time: str, table: str) -> str:
    """`table` with the fractional beat of `time` and its beat's length, found by a plain search."""
    return f"""SELECT p.*, CASE WHEN p.{time} >= s.t1 THEN s.beat + 1 + (p.{time} - s.t1) / (s.t1 - s.t0)::DOUBLE
          ELSE s.beat + (p.{time} - s.t0) / (s.t1 - s.t0)::DOUBLE END AS {alias},
        s.t1 - s.t0 AS {alias}_span
      FROM {table} p JOIN spans s ON s.clip_id = p.clip_id
        AND (p.{time} >= s.t0 OR s.is_first) AND (p.{time} < s.t1 OR s.is_last)"""


add_role("placed_on", "grouped spans", _beat_of("beat_pos", "start", "grouped"))
add_role("placed", "placed_on spans", _beat_of("end_pos", '"offset"', "placed_on"))


def _far(position: str, lines: int) -> str:
    x = f"(({position} - floor({position})) * {lines})"
    return f"abs({x} - round_even({x}, 0)) / {lines}"


def _tolerance(span: str) -> str:
    return f"least(0.125::DOUBLE, 450.0::DOUBLE / {span})"


add_role(
    "grids",
    "placed",
    f"""SELECT clip_id, floor(beat_pos)::BIGINT AS beat, CASE
          WHEN max({_far('beat_pos', 1)}) <= max({_tolerance('beat_pos_span')}) THEN 1
          WHEN max({_far('beat_pos', 2)}) <= max({_tolerance('beat_pos_span')}) THEN 2
          WHEN count(*) >= 2 AND 2 * sum(round({_far('beat_pos', 3)}, 9)::DECIMAL(18, 9))
            < sum(round({_far('beat_pos', 4)}, 9)::DECIMAL(18, 9)) THEN 3 ELSE 4 END::BIGINT AS lines
        FROM placed GROUP BY 1, 2""",
)


def _snap(position: str, lines: str) -> str:
    return (
        f"(floor({position}) * 12 + round_even(({position} - floor({position})) * {lines}, 0)"
        f" * 12 / {lines})::BIGINT"
    )


add_role(
    "gridded",
    "grids placed",
    f"""SELECT q.*, 12 // coalesce(s.lines, 4) AS step12 FROM (
          SELECT p.*, {_snap('beat_pos', 'g.lines')} AS onset12,
            {_snap('end_pos', 'coalesce(e.lines, CASE WHEN ' + _far('end_pos', 1) + ' <= '
                   + _tolerance('end_pos_span') + ' THEN 1 WHEN ' + _far('end_pos', 2) + ' <= '
                   + _tolerance('end_pos_span') + ' THEN 2 ELSE 4 END)')} AS end12
          FROM placed p JOIN grids g ON g.clip_id = p.clip_id AND g.beat = floor(beat_pos)
            LEFT JOIN grids e ON e.clip_id = p.clip_id AND e.beat = floor(end_pos)) q
        LEFT JOIN grids s ON s.clip_id = q.clip_id AND s.beat = floor(q.onset12 / 12)""",
)
add_role(
    "timed",
    "gridded",
    """SELECT g.*, least(greatest(end12 - onset12, step12),
         coalesce(greatest((SELECT min(o.onset12) FROM gridded o WHERE o.clip_id = g.clip_id
           AND o.pitch = g.pitch AND o.onset12 > g.onset12) - onset12, step12), 1000000))
         AS duration12 FROM gridded g""",
)
add_role(
    "merged",
    "timed",
    """SELECT clip_id, pitch, onset12, max(duration12) AS duration12,
         arg_max(note_idx, (velocity, -note_idx)) AS note_idx, max(velocity) AS velocity,
         arg_max(onset, (velocity, -note_idx)) AS onset,
         arg_max("offset", (velocity, -note_idx)) AS "offset" FROM timed GROUP BY 1, 2, 3""",
)
add_role(
    "numbering",
    "merged beats",
    """SELECT clip_id, floor(min(onset12) / 12)::BIGINT AS origin, any_value(phase) AS phase,
         ((any_value(phase) - floor(min(onset12) / 12)::BIGINT) % 4 + 4) % 4 AS pickup
       FROM merged JOIN (SELECT clip_id, arg_max(p, (w, -p)) AS phase FROM (
         SELECT clip_id, beat % 4 AS p, sum(downbeat_weight) AS w FROM beats GROUP BY 1, 2)
         GROUP BY 1) USING (clip_id) GROUP BY 1""",
)
add_role(
    "score",
    "merged numbering",
    """SELECT m.clip_id, note_idx, pitch, velocity, onset, "offset", onset12 - origin * 12 AS onset12,
         duration12 FROM merged m JOIN numbering USING (clip_id)""",
)


def placed(r: Roles):
    notes = r.notes()
    sliced = timeline.sliced_spans(timeline.beat_spans(r.beats()), timeline.reach_of(notes))
    return timeline.to_beats(ops.strum_groups(notes), sliced, "start", "beat_pos")


def gridded(r: Roles):
    notes = r.notes()
    return ops.on_grid(
        ops.strum_groups(notes), timeline.beat_spans(r.beats()), timeline.reach_of(notes)
    )


def score(r: Roles):
    return ops.score_notes(r.notes(), r.beats())


@query(
    "w9_roll_starts",
    with_roles("rolls", "SELECT clip_id, onset, roll_start FROM rolls", recursive=True),
)
def roll_starts(r: Roles):
    return ops.roll_starts(r.notes())


@query(
    "w10_strum_groups",
    with_roles(
        "grouped", "SELECT clip_id, note_idx, start, chord FROM grouped", recursive=True
    ),
)
def strum_groups(r: Roles):
    return ops.strum_groups(r.notes()).select("clip_id", "note_idx", "start", "chord")


@query(
    "w10_strum_directions",
    with_roles(
        "grouped",
        """SELECT clip_id, chord, start, CASE WHEN sum(rise) > sum(fall) THEN 'down' ELSE 'up' END
          AS direction FROM grouped GROUP BY 1, 2, 3
        HAVING count(*) >= 2 AND max(onset) - min(onset) >= 200 AND sum(rise) <> sum(fall)""",
        recursive=True,
    ),
)
def strum_directions(r: Roles):
    return ops.strum_directions(ops.strike_chords(r.notes()))


@query(
    "j12_onset_beats",
    with_roles(
        "spans notes",
        f"SELECT clip_id, note_idx, round(beat_pos, 9) AS beat_pos FROM ({_beat_of('beat_pos', 'onset', 'notes')})",
    ),
)
def onset_beats(r: Roles):
    notes = r.notes()
    sliced = timeline.sliced_spans(timeline.beat_spans(r.beats()), timeline.reach_of(notes))
    placed_notes = timeline.to_beats(notes, sliced, "onset", "beat_pos")
    return placed_notes.select("clip_id", "note_idx", F.round("beat_pos", 9).alias("beat_pos"))


@query(
    "w18_beat_grids",
    with_roles("grids", "SELECT clip_id, beat, lines FROM grids", recursive=True),
)
def beat_grids(r: Roles):
    return ops.beat_grids(placed(r))


@query(
    "f19_grid_distances",
    with_roles(
        "placed_on",
        f"""SELECT clip_id, note_idx, round({_far('beat_pos', 2)}, 9) AS eighths,
          round({_far('beat_pos', 3)}, 9) AS triplets,
          round({_tolerance('beat_pos_span')}, 9) AS tolerance FROM placed_on""",
        recursive=True,
    ),
)
def grid_distances(r: Roles):
    fraction = F.col("beat_pos") - F.floor("beat_pos")
    return placed(r).select(
        "clip_id",
        "note_idx",
        F.round(ops.grid_distance(fraction, 2), 9).alias("eighths"),
        F.round(ops.grid_distance(fraction, 3), 9).alias("triplets"),
        F.round(ops.beat_tolerance(F.col("beat_pos_span")), 9).alias("tolerance"),
    )


@query(
    "w19_snapped_notes",
    with_roles(
        "gridded", "SELECT clip_id, note_idx, onset12, end12, step12 FROM gridded", recursive=True
    ),
)
def snapped_notes(r: Roles):
    return gridded(r).select("clip_id", "note_idx", "onset12", "end12", "step12")


@query(
    "w12_durations",
    with_roles(
        "timed", "SELECT clip_id, note_idx, onset12, duration12 FROM timed", recursive=True
    ),
)
def durations(r: Roles):
    return ops.with_durations(gridded(r)).select("clip_id", "note_idx", "onset12", "duration12")


@query(
    "a19_merged_notes",
    with_roles(
        "merged",
        "SELECT clip_id, pitch, onset12, duration12, note_idx, velocity FROM merged",
        recursive=True,
    ),
)
def merged_notes(r: Roles):
    merged = ops.merged_notes(gridded(r))
    return merged.select("clip_id", "pitch", "onset12", "duration12", "note_idx", "velocity")


@query(
    "a17_phase_from_weights",
    with_roles(
        "beats",
        """SELECT clip_id, arg_max(p, (w, -p)) AS phase FROM (SELECT clip_id, beat % 4 AS p,
          sum(downbeat_weight) AS w FROM beats GROUP BY 1, 2) GROUP BY 1""",
    ),
)
def phase_from_weights(r: Roles):
    return ops.downbeat_phase_from_weights(r.beats())


@query(
    "a17_phase_from_notes",
    with_roles(
        "merged",
        """SELECT clip_id, CASE WHEN max(w) > 0 THEN arg_max(p, (w, -p)) ELSE 0 END AS phase FROM (
          SELECT clip_id, (onset12 // 12) % 4 AS p,
            sum(CASE WHEN onset12 % 12 = 0 THEN velocity ELSE 0 END) AS w
          FROM merged GROUP BY 1, 2) GROUP BY 1""",
        recursive=True,
    ),
)
def phase_from_notes(r: Roles):
    merged = ops.merged_notes(gridded(r))
    return ops.downbeat_phase_from_notes(merged)


@query(
    "w20_numbering",
    with_roles("numbering", "SELECT clip_id, origin, pickup FROM numbering", recursive=True),
)
def numbering(r: Roles):
    return score(r)[1]


# Every fifth clip without beats, every fifth with one, every fifth without downbeat weights.
_SPARSE = {
    "all_beats": ("notes", _CTES["beats"][1]),
    "found_beats": (
        "all_beats",
        """SELECT clip_id, beat, tick, CASE WHEN clip_id % 5 <> 2 THEN downbeat_weight END AS downbeat_weight
           FROM all_beats WHERE clip_id % 5 > 1 OR (clip_id % 5 = 1 AND beat = 0)""",
    ),
    "beats": (
        "found_beats notes",
        """WITH enough AS (SELECT clip_id FROM found_beats GROUP BY 1 HAVING count(*) >= 2)
           SELECT clip_id, beat, tick, downbeat_weight FROM found_beats JOIN enough USING (clip_id)
           UNION ALL SELECT clip_id, b::BIGINT, min(onset) + b * 5000, NULL
           FROM notes, range(0, 2) t(b) WHERE clip_id NOT IN (SELECT clip_id FROM enough) GROUP BY clip_id, b""",
    ),
    "numbering": (
        "merged beats",
        """WITH by_weight AS (SELECT clip_id, arg_max(p, (w, -p)) AS phase FROM (
             SELECT clip_id, beat % 4 AS p, sum(downbeat_weight) AS w FROM beats
             WHERE downbeat_weight IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
           by_notes AS (SELECT clip_id, arg_max(p, (w, -p)) AS phase FROM (
             SELECT clip_id, (floor(onset12 / 12)::BIGINT % 4 + 4) % 4 AS p,
               sum(CASE WHEN onset12 % 12 = 0 THEN velocity ELSE 0 END) AS w FROM merged GROUP BY 1, 2)
             GROUP BY 1 HAVING max(w) > 0),
           firsts AS (SELECT clip_id, floor(min(onset12) / 12)::BIGINT AS origin FROM merged GROUP BY 1)
           SELECT f.clip_id, origin, coalesce(w.phase, n.phase, 0) AS phase,
             ((coalesce(w.phase, n.phase, 0) - origin) % 4 + 4) % 4 AS pickup
           FROM firsts f LEFT JOIN by_weight w USING (clip_id) LEFT JOIN by_notes n USING (clip_id)""",
    ),
}


def sparse_score(r: Roles):
    found = r.beats().where("clip_id % 5 > 1 or (clip_id % 5 = 1 and beat = 0)")
    weight = F.when(F.col("clip_id") % 5 != 2, F.col("downbeat_weight"))
    return ops.score_notes(r.notes(), found.withColumn("downbeat_weight", weight))


@query(
    "w20_numbering_of_sparse_beats",
    with_roles("numbering", "SELECT clip_id, origin, pickup FROM numbering", True, _SPARSE),
)
def sparse_numbering(r: Roles):
    return sparse_score(r)[1]


@query(
    "s7_score_of_sparse_beats",
    with_roles("score", "SELECT clip_id, note_idx, pitch, onset12, duration12 FROM score", True, _SPARSE),
)
def sparse_score_notes(r: Roles):
    return sparse_score(r)[0].select("clip_id", "note_idx", "pitch", "onset12", "duration12")


@query(
    "s7_score_notes",
    with_roles("score", "SELECT clip_id, note_idx, pitch, onset12, duration12 FROM score", recursive=True),
)
def score_notes(r: Roles):
    return score(r)[0].select("clip_id", "note_idx", "pitch", "onset12", "duration12")


@query(
    "t7_canonical_note_order",
    with_roles("score", "SELECT clip_id, onset12, pitch FROM score", recursive=True),
)
def canonical_note_order(r: Roles):
    return score(r)[0].select("clip_id", "onset12", "pitch").orderBy("clip_id", "onset12", "pitch")


@query(
    "a36_note_counts",
    with_roles("score", "SELECT clip_id, count(*) AS note_count FROM score GROUP BY 1", recursive=True),
)
def note_counts(r: Roles):
    return score(r)[0].groupBy("clip_id").agg(F.count(F.lit(1)).alias("note_count"))


@query(
    "a18_tempo",
    with_roles(
        "spans",
        """SELECT clip_id, 60.0::DOUBLE / (quantile_cont(t1 - t0, 0.5)::DOUBLE / 10000.0::DOUBLE)
          AS tempo_bpm FROM spans GROUP BY 1""",
    ),
)
def tempo(r: Roles):
    return timeline.tempo(r.beats())


@query(
    "f17_recording_end",
    with_roles(
        "spans notes",
        f"""SELECT clip_id, round_even(greatest(end_beat, 0) * 48, 0)::BIGINT AS end48 FROM (
          {_beat_of('end_beat', 'end_tick', '(SELECT clip_id, max("offset") + 1500 AS end_tick FROM notes GROUP BY 1)')})""",
    ),
)
def recording_end(r: Roles):
    notes = r.notes()
    ends = notes.groupBy("clip_id").agg((F.max("offset") + 1500).alias("end_tick"))
    reach = ends.withColumnRenamed("end_tick", "reach")
    sliced = timeline.sliced_spans(timeline.beat_spans(r.beats()), reach)
    return timeline.recording_end(ends, sliced)


@query(
    "f15_velocities",
    with_roles(
        "notes",
        """SELECT clip_id, note_idx, least(127, greatest(1, round_even(127 * (k2 / 100.0::DOUBLE), 0)))
          ::BIGINT AS velocity, round_even(greatest(0, k2 / 64.0::DOUBLE - 0.5), 4) AS onset_s
        FROM (SELECT *, (velocity * 7 % 131) - 5 AS k2 FROM notes)""",
    ),
)
def velocities(r: Roles):
    raw = F.col("velocity") * 7 % 131 - 5
    return r.notes().select(
        "clip_id",
        "note_idx",
        F.least(F.lit(127), F.greatest(F.lit(1), F.bround(F.lit(127) * (raw / 100.0))))
        .cast("bigint")
        .alias("velocity"),
        F.bround(F.greatest(F.lit(0.0), raw / 64.0 - 0.5), 4).alias("onset_s"),
    )


@query(
    "p16_notes_in_range",
    with_roles("annotated", "SELECT clip_id, note_idx, pitch FROM annotated WHERE pitch BETWEEN 38 AND 88"),
)
def notes_in_range(r: Roles):
    from tonelake.functions.constants import PITCH_RANGE

    low, high = PITCH_RANGE["guitar"]
    return r.annotated().where(F.col("pitch").between(low, high)).select("clip_id", "note_idx", "pitch")


