"""Bar, voice, key and chord queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.functions import text
from tonelake.functions.constants import NOTE_NAMES
from tonelake.operators import bars as bar_ops
from tonelake.operators import harmony as ops
from tonelake.operators import timeline
from tonelake.plans.registry import query
from tonelake.plans.rhythm import score
from tonelake.plans.role_sql import add_role, with_roles
from tonelake.sources.roles import Roles

add_role(
    "ends",
    "score numbering",
    """SELECT clip_id, end12, origin, pickup, first12,
         ceil(greatest(0, end12 - first12) / 48.0::DOUBLE)::BIGINT AS full_bars
       FROM (SELECT clip_id, max(onset12 + duration12) AS end12 FROM score GROUP BY 1)
       JOIN (SELECT *, CASE WHEN pickup > 0 THEN pickup * 12 ELSE 48 END AS first12 FROM numbering)
         USING (clip_id)""",
)
add_role(
    "bars",
    "ends",
    """SELECT clip_id, origin, bar, CASE WHEN bar = 0 THEN 0 ELSE first12 + (bar - 1) * 48 END AS start12,
         first12 + bar * 48 AS end12
       FROM (SELECT *, unnest(range(0, full_bars + 1)) AS bar FROM ends)""",
)
add_role(
    "bar_ms",
    "bars spans",
    """SELECT b.clip_id, bar, end12 - start12 AS length12,
         round_even((CASE WHEN p >= s.beat + 1 THEN t1 + (p - s.beat - 1) * (t1 - t0)
           ELSE t0 + (p - s.beat) * (t1 - t0) END + b.clip_id % 7 * 100) / 10, 0)::BIGINT AS start_ms
       FROM (SELECT *, start12 / 12.0::DOUBLE + origin AS p FROM bars) b
         JOIN spans s ON s.clip_id = b.clip_id AND (p >= s.beat OR is_first)
           AND (p < s.beat + 1 OR is_last)""",
)
add_role(
    "chords_played",
    "score",
    """SELECT clip_id, onset12, list_sort(list_distinct(list(pitch))) AS pitches,
         max(onset12 + duration12) AS stop12 FROM score GROUP BY 1, 2""",
)
add_role(
    "voices",
    "chords_played ends",
    """WITH p AS (SELECT *, least(stop12, coalesce(lead(onset12) OVER w, stop12)) AS end12
           FROM chords_played WINDOW w AS (PARTITION BY clip_id ORDER BY onset12)),
         q AS (SELECT *, coalesce(lag(end12) OVER (PARTITION BY clip_id ORDER BY onset12), 0) AS free
           FROM p)
       SELECT clip_id, onset12 AS start12, end12, array_to_string(pitches, ',') AS pitches FROM q
       UNION ALL SELECT clip_id, free, onset12, '' FROM q WHERE onset12 > free
       UNION ALL SELECT clip_id, max(q.end12), any_value(first12 + full_bars * 48), ''
         FROM q JOIN ends USING (clip_id) GROUP BY 1
         HAVING max(q.end12) < any_value(first12 + full_bars * 48)""",
)
# voices of an edited score: durations stretched off the grid
add_role(
    "edited",
    "score",
    """SELECT clip_id, onset12 + note_idx % 5 AS start12,
         onset12 + note_idx % 5 + duration12 + note_idx % 3 AS end12, note_idx FROM score""",
)
add_role(
    "points",
    "edited",
    """SELECT clip_id, start12 AS point12 FROM edited UNION SELECT clip_id, end12 FROM edited""",
)


def ends(r: Roles):
    return bar_ops.score_ends(*score(r))


def bar_rows(r: Roles):
    return bar_ops.bar_lines(ends(r))


def bar_start_rows(r: Roles):
    trims = r.beats().select("clip_id", (F.col("clip_id") % 7 * 100).alias("trim")).distinct()
    return bar_ops.bar_starts(bar_rows(r), timeline.beat_spans(r.beats()), trims)


def voice_rows(r: Roles):
    notes, numbers = score(r)
    return bar_ops.voice(notes, bar_ops.score_ends(notes, numbers))


def edited(r: Roles):
    shift = F.col("onset12") + F.col("note_idx") % 5
    return score(r)[0].select(
        "clip_id",
        shift.alias("start12"),
        (shift + F.col("duration12") + F.col("note_idx") % 3).alias("end12"),
        "note_idx",
    )


@query(
    "w21_bar_lines",
    with_roles("bars", "SELECT clip_id, bar, start12, end12 FROM bars", recursive=True),
)
def bar_lines(r: Roles):
    return bar_rows(r).select("clip_id", "bar", "start12", "end12")


@query(
    "a36_measures",
    with_roles("bars", "SELECT clip_id, count(*) AS measures FROM bars GROUP BY 1", recursive=True),
)
def measures(r: Roles):
    return bar_rows(r).groupBy("clip_id").agg(F.count(F.lit(1)).alias("measures"))


@query(
    "w22_bar_starts",
    with_roles("bar_ms", "SELECT clip_id, bar, start_ms FROM bar_ms", recursive=True),
)
def bar_starts(r: Roles):
    return bar_start_rows(r).select("clip_id", "bar", "start_ms")


@query(
    "w29_bar_paces",
    with_roles(
        "bar_ms",
        """WITH o AS (SELECT *, lead(start_ms) OVER (PARTITION BY clip_id ORDER BY bar) - start_ms AS w
            FROM bar_ms),
          p AS (SELECT *, CASE WHEN w > 0 THEN length12 / 12.0::DOUBLE * 60000 / w END AS own FROM o)
        SELECT clip_id, bar, coalesce(round(last_value(own IGNORE NULLS) OVER (PARTITION BY clip_id
          ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6), -1) AS bpm FROM p""",
        recursive=True,
    ),
)
def bar_paces(r: Roles):
    paces = bar_ops.bar_paces(bar_start_rows(r))
    return paces.withColumn("bpm", F.coalesce(F.round("bpm", 6), F.lit(-1.0)))


@query(
    "w16_voice_events",
    with_roles("voices", "SELECT clip_id, start12, end12, pitches FROM voices", recursive=True),
)
def voice_events(r: Roles):
    joined = F.array_join(F.col("pitches").cast("array<string>"), ",")
    return voice_rows(r).withColumn("pitches", joined)


@query(
    "j19_bar_pieces",
    with_roles(
        "voices bars",
        """SELECT v.clip_id, bar, greatest(v.start12, b.start12) AS from12,
          least(v.end12, b.end12) AS to12, pitches,
          pitches <> '' AND least(v.end12, b.end12) < v.end12 AS tie_start,
          pitches <> '' AND greatest(v.start12, b.start12) > v.start12 AS tie_stop
        FROM voices v JOIN bars b ON b.clip_id = v.clip_id AND v.start12 < b.end12
          AND b.start12 < v.end12""",
        recursive=True,
    ),
)
def bar_pieces(r: Roles):
    notes, numbers = score(r)
    limits = bar_ops.score_ends(notes, numbers)
    return bar_ops.bar_pieces(bar_ops.voice(notes, limits), limits)


@query(
    "x4_event_boundaries",
    with_roles("points", "SELECT clip_id, point12 FROM points", recursive=True),
)
def event_boundaries(r: Roles):
    return bar_ops.boundaries(edited(r))


@query(
    "w17_regridded_events",
    with_roles(
        "points edited",
        """WITH t AS (SELECT clip_id, floor(point12 / 12) AS beat, bool_and(point12 % 4 = 0) AS thirds
            FROM points WHERE point12 % 12 <> 0 GROUP BY 1, 2),
          m AS (SELECT p.clip_id, point12, CASE WHEN point12 % 12 = 0 THEN point12
              ELSE (floor(point12 / 12) * 12 + round_even((point12 % 12) * CASE WHEN thirds THEN 3
                ELSE 4 END / 12.0::DOUBLE, 0) * 12 / CASE WHEN thirds THEN 3 ELSE 4 END)::BIGINT
              END AS moved
            FROM points p LEFT JOIN t ON t.clip_id = p.clip_id AND t.beat = floor(point12 / 12))
        SELECT e.clip_id, note_idx, a.moved AS start12, b.moved AS end12 FROM edited e
          JOIN m a ON a.clip_id = e.clip_id AND a.point12 = e.start12
          JOIN m b ON b.clip_id = e.clip_id AND b.point12 = e.end12 WHERE a.moved < b.moved""",
        recursive=True,
    ),
)
def regridded_events(r: Roles):
    return bar_ops.regrid(edited(r)).select("clip_id", "note_idx", "start12", "end12")


# --- key ---

add_role(
    "histogram",
    "score",
    """SELECT clip_id, pc, coalesce(sum(duration12) FILTER (pitch % 12 = pc), 0)::BIGINT AS total
       FROM score, range(0, 12) t(pc) GROUP BY 1, 2""",
)
_PROFILES = """SELECT unnest(range(0, 12)) AS step, unnest([6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52,
    5.19, 2.39, 3.66, 2.29, 2.88]::DOUBLE[]) AS weight, 'major' AS mode UNION ALL
  SELECT unnest(range(0, 12)), unnest([6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69,
    3.34, 3.17]::DOUBLE[]), 'minor'"""


@query(
    "a16_pitch_class_histogram",
    with_roles(
        "histogram",
        """SELECT clip_id, string_agg(total::VARCHAR, ',' ORDER BY pc) AS histogram FROM histogram
        GROUP BY 1""",
        recursive=True,
    ),
)
def pitch_class_histogram(r: Roles):
    h = ops.pitch_class_histogram(score(r)[0])
    joined = F.array_join(F.col("histogram").cast("array<string>"), ",")
    return h.withColumn("histogram", joined)


@query(
    "j16_estimated_keys",
    with_roles(
        "histogram",
        f"""WITH profiles AS ({_PROFILES}),
          scored AS (SELECT clip_id, tonic, mode, corr(total::DOUBLE, weight) AS c
            FROM histogram JOIN profiles ON true JOIN range(0, 12) t(tonic)
              ON (step + tonic) % 12 = pc GROUP BY 1, 2, 3),
          best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY clip_id
            ORDER BY c DESC, tonic, mode) = 1)
        SELECT clip_id, tonic::INT AS tonic, mode, ([0, -5, 2, -3, 4, -1, 6, 1, -4, 3, -2, 5])
          [CASE WHEN mode = 'major' THEN tonic ELSE (tonic + 3) % 12 END + 1] AS fifths FROM best""",
        recursive=True,
    ),
)
def estimated_keys(r: Roles):
    return ops.estimate_key(ops.pitch_class_histogram(score(r)[0]))


# --- chords from frames ---

FRAME_HOP, FRAME_RATE, WINDOW = 256, 22_050, 172
WINDOW_OFFSET = (FRAME_HOP / FRAME_RATE) * (WINDOW - (2 * FRAME_RATE - FRAME_HOP) / FRAME_HOP) + 0.0018


def frame_time(frame):
    """Start of an activation frame in seconds, with the correction at each model window."""
    return frame * FRAME_HOP / FRAME_RATE - F.lit(WINDOW_OFFSET) * F.floor(frame / WINDOW)


_TIME = f"frame * 256 / 22050.0::DOUBLE - {WINDOW_OFFSET!r}::DOUBLE * floor(frame / 172)"
add_role(
    "frame_times", "frames", f"SELECT DISTINCT clip_id, frame, {_TIME} AS time_s FROM frames"
)
add_role(
    "chord_beats",
    "frame_times",
    """SELECT clip_id, unnest(range(0, beats)) AS beat, beat * (clip_id % 4 * 5 + 15) / 100.0::DOUBLE
         AS beat_s FROM (SELECT clip_id, floor(max(time_s) / ((clip_id % 4 * 5 + 15) / 100.0::DOUBLE))
           ::BIGINT + 2 AS beats FROM frame_times GROUP BY clip_id)""",
)
add_role(
    "chord_spans",
    "chord_beats",
    """SELECT clip_id, beat * 2 + part AS span,
         beat_s + (next_s - beat_s) * (part / 2.0::DOUBLE) AS start_s,
         CASE WHEN part = 1 THEN next_s ELSE beat_s + (next_s - beat_s) * 0.5::DOUBLE END AS end_s
       FROM (SELECT *, lead(beat_s) OVER (PARTITION BY clip_id ORDER BY beat) AS next_s
         FROM chord_beats), (SELECT unnest([0, 1]) AS part) WHERE next_s IS NOT NULL""",
)
add_role(
    "span_members",
    "chord_spans frame_times",
    """WITH n AS (SELECT clip_id, count(*) AS frames FROM frame_times GROUP BY 1),
         b AS (SELECT s.clip_id, span, n.frames,
             (SELECT count(*) FROM frame_times t WHERE t.clip_id = s.clip_id AND t.time_s < s.start_s)
               AS first,
             (SELECT count(*) FROM frame_times t WHERE t.clip_id = s.clip_id AND t.time_s < s.end_s)
               AS stop FROM chord_spans s JOIN n ON n.clip_id = s.clip_id)
       SELECT clip_id, span, unnest(range(least(first, frames - 1),
         least(greatest(stop, first + 1), frames))) AS frame FROM b""",
)
add_role(
    "chroma",
    "span_members frames",
    """SELECT clip_id, span, pitch % 12 AS pc, sum(value * value * value) / count(DISTINCT frame) AS c,
         coalesce(sum(value * value * value) FILTER (pitch <= 52), 0) / count(DISTINCT frame) AS b
       FROM span_members JOIN frames USING (clip_id, frame) GROUP BY 1, 2, 3""",
)
add_role(
    "templates",
    "",
    """SELECT root, q, quality, (root + step) % 12 AS pc, root * 5 + q AS state,
         sqrt(len(steps)) AS size FROM (SELECT root, q, quality, steps, unnest(steps) AS step
         FROM range(0, 12) r(root), (SELECT unnest([0, 1, 2, 3, 4]) AS q,
           unnest(['maj', 'min', '7', 'maj7', 'min7']) AS quality,
           unnest([[0,4,7], [0,3,7], [0,4,7,10], [0,4,7,11], [0,3,7,10]]) AS steps))""",
)
add_role(
    "span_scores",
    "chroma templates",
    """WITH t AS (SELECT clip_id, span, sqrt(sum(c * c)) AS norm, sum(b) AS bass, sum(c) AS total
           FROM chroma GROUP BY 1, 2),
         m AS (SELECT clip_id, span, state, any_value(root) AS root, sum(c) / any_value(size) AS hit
           FROM chroma JOIN templates USING (pc) GROUP BY 1, 2, 3)
       SELECT m.clip_id, m.span, state, hit / greatest(norm, 1e-9) + 0.3::DOUBLE * r.b
         / greatest(bass, 1e-9) AS score, total < 0.02 AS silent
       FROM m JOIN t USING (clip_id, span) JOIN chroma r ON r.clip_id = m.clip_id
         AND r.span = m.span AND r.pc = m.root""",
)
# the same decoding as a table of states per step, walked forwards and then back
add_role(
    "span_rows",
    "span_scores",
    """SELECT clip_id, span, list(CASE WHEN silent THEN -1e300 ELSE 10 * score END ORDER BY state)
         || [CASE WHEN any_value(silent) THEN 10.0 ELSE -1e300 END] AS s
       FROM span_scores GROUP BY 1, 2""",
)
add_role(
    "forward_steps",
    "span_rows",
    """SELECT clip_id, span, s AS best, list_transform(s, lambda x: 0) AS came FROM span_rows
         WHERE span = 0
       UNION ALL
       SELECT clip_id, span, list_transform(s, lambda x, i: x + greatest(b[i] + ln(0.95::DOUBLE),
           top + ln(0.05::DOUBLE / 60))),
         list_transform(s, lambda x, i: CASE WHEN b[i] + ln(0.95::DOUBLE) >= top
           + ln(0.05::DOUBLE / 60) THEN i ELSE list_position(b, top) END)
       FROM (SELECT n.clip_id, n.span, n.s, f.best AS b, list_max(f.best) AS top
         FROM forward_steps f JOIN span_rows n ON n.clip_id = f.clip_id AND n.span = f.span + 1)""",
)
add_role(
    "chord_states",
    "forward_steps",
    """SELECT clip_id, span, list_position(best, list_max(best)) AS state1 FROM forward_steps
         WHERE (clip_id, span) IN (SELECT (clip_id, max(span)) FROM span_rows GROUP BY clip_id)
       UNION ALL SELECT c.clip_id, f.span - 1, f.came[c.state1] FROM chord_states c
         JOIN forward_steps f ON f.clip_id = c.clip_id AND f.span = c.span WHERE f.span > 0""",
)


def frame_times(r: Roles):
    return r.frames().select("clip_id", "frame").distinct().withColumn(
        "time_s", frame_time(F.col("frame"))
    )


def chord_beats(r: Roles):
    """Beats of a clip from 0 to the first one after its last frame, so every frame has a span."""
    step = (F.col("clip_id") % 4 * 5 + 15) / 100.0
    last = frame_times(r).groupBy("clip_id").agg(F.max("time_s").alias("last_s"))
    beats = F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("last_s") / step) + 1)
    return last.select("clip_id", F.explode(beats).alias("beat")).withColumn(
        "beat_s", F.col("beat") * (F.col("clip_id") % 4 * 5 + 15) / 100.0
    )


def chord_spans(r: Roles):
    return ops.chord_edges(chord_beats(r))


def members(r: Roles):
    return ops.span_frames(chord_spans(r), frame_times(r))


def chroma(r: Roles):
    return ops.span_chroma(members(r), r.frames())


def scores(r: Roles):
    return ops.chord_scores(chroma(r))


@query(
    "f16_frame_times",
    with_roles("frame_times", "SELECT clip_id, frame, round(time_s, 9) AS time_s FROM frame_times"),
)
def frame_time_rows(r: Roles):
    return frame_times(r).withColumn("time_s", F.round("time_s", 9))


@query(
    "j13_span_frames",
    with_roles("span_members", "SELECT clip_id, span, frame FROM span_members"),
)
def span_frames(r: Roles):
    return members(r)


@query(
    "a20_span_chroma",
    with_roles(
        "chroma",
        "SELECT clip_id, span, pc::INT AS pc, round(c, 6) AS chroma, round(b, 6) AS bass FROM chroma",
    ),
)
def span_chroma(r: Roles):
    rows = chroma(r).select(
        "clip_id", "span", F.posexplode(F.arrays_zip("chroma", "bass")).alias("pc", "v")
    )
    return rows.select(
        "clip_id", "span", "pc", F.round("v.chroma", 6).alias("chroma"), F.round("v.bass", 6).alias("bass")
    )


@query(
    "f20_template_scores",
    with_roles(
        "span_scores",
        "SELECT clip_id, span, state::INT AS state, round(score, 6) AS score FROM span_scores",
    ),
)
def template_scores(r: Roles):
    rows = scores(r).select("clip_id", "span", F.posexplode("scores").alias("state", "score"))
    return rows.withColumn("score", F.round("score", 6))


@query(
    "j15_best_templates",
    with_roles(
        "span_scores",
        """SELECT clip_id, span, CASE WHEN any_value(silent) THEN 60
          ELSE arg_max(state, (score, -state)) END::INT AS state FROM span_scores GROUP BY 1, 2""",
    ),
)
def best_templates(r: Roles):
    return ops.best_template(scores(r))


@query(
    "w23_decoded_chords",
    with_roles(
        "chord_states", "SELECT clip_id, span, state1 - 1 AS state FROM chord_states", recursive=True
    ),
)
def decoded_chords(r: Roles):
    return ops.decode_chords(scores(r))


_NAMES = str(list(NOTE_NAMES))
_SYMBOLS = """WITH c AS (SELECT *, state1 - 1 AS state FROM chord_states WHERE state1 <= 60),
    o AS (SELECT *, span - row_number() OVER (PARTITION BY clip_id, state ORDER BY span) AS run FROM c)
  SELECT o.clip_id, state // 5 AS root, (['maj', 'min', '7', 'maj7', 'min7'])[state % 5 + 1] AS quality,
    min(o.span) * 6 AS onset12, count(*) * 6 AS duration12, round_even(min(start_s), 4) AS onset_s,
    round_even(max(end_s), 4) AS offset_s
  FROM o JOIN chord_spans USING (clip_id, span) GROUP BY o.clip_id, state, run"""


@query("w15_chord_symbols", with_roles("chord_states chord_spans", _SYMBOLS, recursive=True))
def chord_symbols(r: Roles):
    return ops.chord_symbols(ops.decode_chords(scores(r)), chord_spans(r))


@query(
    "f5_chord_labels",
    with_roles(
        "span_scores",
        f"""SELECT clip_id, span, CASE WHEN any_value(silent) THEN 'N' ELSE ({_NAMES})
            [arg_max(state, (score, -state)) // 5 + 1] || ':' ||
            (['maj', 'min', '7', 'maj7', 'min7'])[arg_max(state, (score, -state)) % 5 + 1] END AS label
        FROM span_scores GROUP BY 1, 2""",
    ),
)
def chord_labels(r: Roles):
    quality = F.element_at(F.array(*map(F.lit, ops.QUALITIES)), F.col("state") % 5 + 1)
    label = text.chord_label(F.expr("state div 5"), quality)
    return ops.best_template(scores(r)).select(
        "clip_id", "span", F.when(F.col("state") == ops.NO_CHORD, "N").otherwise(label).alias("label")
    )


# --- labelled segments over the beats of the note clips ---

add_role(
    "truth_chords",
    "beats",
    f"""SELECT a.clip_id, a.tick AS start, b.tick AS "end", ({_NAMES})[(a.clip_id * 5
          + a.beat // 4 * 7) % 12 + 1] || ':' || (['maj', 'min', '7'])[a.beat // 4 % 3 + 1] AS label
        FROM beats a JOIN beats b ON b.clip_id = a.clip_id AND b.beat = a.beat + 4
        WHERE a.beat % 4 = 0""",
)
add_role(
    "found_chords",
    "beats",
    f"""SELECT a.clip_id, a.tick + 40 AS start, b.tick - a.clip_id % 2 * 900 AS "end",
          ({_NAMES})[(a.clip_id * 5 + a.beat // 4 * 7 + CASE WHEN a.beat % 3 = 0 THEN 2 ELSE 0 END)
            % 12 + 1] || ':' || (['maj', 'min', 'maj7', 'min7'])[a.beat // 2 % 4 + 1] AS label
        FROM beats a JOIN beats b ON b.clip_id = a.clip_id AND b.beat = a.beat + 2
        WHERE a.beat % 2 = 0""",
)
add_role(
    "filled_chords",
    "truth_chords found_chords",
    """WITH x AS (SELECT clip_id, min(start) AS low, max("end") AS high FROM truth_chords GROUP BY 1),
         g AS (SELECT f.*, low, high, coalesce(lag("end") OVER (PARTITION BY clip_id ORDER BY start),
           low) AS free FROM found_chords f JOIN x USING (clip_id)),
         last AS (SELECT clip_id, max("end") AS last FROM found_chords GROUP BY 1)
       SELECT clip_id, start, "end", label FROM found_chords UNION ALL
       SELECT clip_id, greatest(free, low), least(start, high), 'N' FROM g
         WHERE start > free AND greatest(free, low) < least(start, high) UNION ALL
       SELECT clip_id, coalesce(last, low), high, 'N' FROM x LEFT JOIN last USING (clip_id)
         WHERE coalesce(last, low) < high""",
)
add_role(
    "shared_chords",
    "truth_chords filled_chords",
    """SELECT t.clip_id, t.label AS left_label, f.label AS right_label,
         greatest(t.start, f.start) AS from_t, least(t."end", f."end") AS to_t
       FROM truth_chords t JOIN filled_chords f ON f.clip_id = t.clip_id AND f.start < t."end"
         AND t.start < f."end" """,
)


def _segments(r: Roles, step: int, start, end, label):
    beats = r.beats().select("clip_id", "beat", "tick")
    later = beats.select("clip_id", (F.col("beat") - step).alias("beat"), F.col("tick").alias("later"))
    return (
        beats.where(F.col("beat") % step == 0)
        .join(later, ["clip_id", "beat"])
        .select("clip_id", start.alias("start"), end.alias("end"), label.alias("label"))
    )


def truth_chords(r: Roles):
    bar = F.expr("beat div 4")
    quality = F.element_at(F.array(*map(F.lit, ["maj", "min", "7"])), (bar % 3 + 1).cast("int"))
    label = text.chord_label((F.col("clip_id") * 5 + bar * 7) % 12, quality)
    return _segments(r, 4, F.col("tick"), F.col("later"), label)


def found_chords(r: Roles):
    off = F.when(F.col("beat") % 3 == 0, 2).otherwise(0)
    qualities = F.array(*map(F.lit, ["maj", "min", "maj7", "min7"]))
    quality = F.element_at(qualities, (F.expr("beat div 2") % 4 + 1).cast("int"))
    label = text.chord_label((F.col("clip_id") * 5 + F.expr("beat div 4") * 7 + off) % 12, quality)
    end = F.col("later") - F.col("clip_id") % 2 * 900
    return _segments(r, 2, F.col("tick") + 40, end, label)


def filled_chords(r: Roles):
    extent = truth_chords(r).groupBy("clip_id").agg(
        F.min("start").alias("low"), F.max("end").alias("high")
    )
    return ops.fill_gaps(found_chords(r), extent)


def shared_chords(r: Roles):
    return timeline.overlaps(truth_chords(r), filled_chords(r))


@query(
    "x6_filled_segments",
    with_roles("filled_chords", 'SELECT clip_id, start, "end", label FROM filled_chords'),
)
def filled_segments(r: Roles):
    return filled_chords(r)


@query(
    "j14_segment_overlaps",
    with_roles("shared_chords", "SELECT clip_id, left_label, right_label, from_t, to_t FROM shared_chords"),
)
def segment_overlaps(r: Roles):
    return shared_chords(r)


_TRIAD = """CASE WHEN {0} = 'N' THEN 'N' ELSE split_part({0}, ':', 1) || CASE WHEN
  starts_with(split_part({0}, ':', 2), 'min') THEN ':min' ELSE ':maj' END END"""


@query(
    "a28_chord_accuracy",
    with_roles(
        "shared_chords",
        f"""SELECT clip_id, sum(CASE WHEN split_part(left_label, ':', 1)
            = split_part(right_label, ':', 1) THEN to_t - from_t ELSE 0 END)::DOUBLE
            / sum(to_t - from_t)::DOUBLE AS chord_root,
          sum(CASE WHEN {_TRIAD.format('left_label')} = {_TRIAD.format('right_label')}
            THEN to_t - from_t ELSE 0 END)::DOUBLE / sum(to_t - from_t)::DOUBLE AS chord_majmin
        FROM shared_chords GROUP BY 1""",
    ),
)
def chord_accuracy(r: Roles):
    return ops.chord_accuracy(shared_chords(r))
