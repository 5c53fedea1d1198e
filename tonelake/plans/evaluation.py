"""Tablature, matching, scoring, tuning, edit replay and incremental queries.

The second reading of the notes stands for the annotation; the notes and their score are judged
against it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.functions import constants as k
from tonelake.operators import edits as edit_ops
from tonelake.operators import evaluation as ops
from tonelake.operators import harmony, incremental, matching, rhythm, timeline
from tonelake.operators import tablature as tab_ops
from tonelake.plans.harmony import chroma
from tonelake.plans.registry import query
from tonelake.plans.rhythm import _beat_of, gridded, score
from tonelake.plans.role_sql import add_role, with_roles
from tonelake.session import scratch_path, settle
from tonelake.sources.roles import Roles

# --- tablature ---

_BOARD = """(SELECT unnest([6, 5, 4, 3, 2, 1]) AS string, unnest([40, 45, 50, 55, 59, 64]) AS open_pitch)"""
add_role(
    "candidates",
    "score",
    f"""SELECT s.*, string, pitch - open_pitch AS fret FROM score s, {_BOARD}
        WHERE pitch - open_pitch BETWEEN 0 AND 24""",
)
# the annotated string of a note: one of those that can play it
add_role(
    "stringed",
    "annotated",
    f"""SELECT * FROM (SELECT a.*, string, row_number() OVER (PARTITION BY clip_id, note_idx
            ORDER BY string) - 1 AS place, count(*) OVER (PARTITION BY clip_id, note_idx) AS n
          FROM annotated a, {_BOARD} WHERE pitch - open_pitch BETWEEN 0 AND 24)
        WHERE place = note_idx % n""",
)
# a simple tab: every fifth note is left out, the others take their lowest fret
add_role(
    "simple_tab",
    "candidates",
    """SELECT clip_id, onset12, pitch, arg_min(string, fret) AS string, min(fret) AS fret
       FROM candidates WHERE note_idx % 5 <> 0 GROUP BY 1, 2, 3""",
)
add_role("placed_score", "score simple_tab", """SELECT s.*, t.string, t.fret FROM score s
    JOIN simple_tab t USING (clip_id, onset12, pitch)""")


def stringed(r: Roles):
    """Annotated notes with the string they were played on, picked among the playable ones."""
    options = F.array(
        *[
            F.when(F.col("pitch").between(o, o + k.MAX_FRET), F.lit(len(k.STANDARD_TUNING) - i))
            for i, o in reversed(list(enumerate(k.STANDARD_TUNING)))
        ]
    )
    able = F.array_compact(options)
    place = (F.col("note_idx") % F.size("able") + 1).cast("int")
    return (
        r.annotated()
        .withColumn("able", able)
        .where(F.size("able") > 0)
        .withColumn("string", F.element_at("able", place))
        .drop("able")
    )


def simple_tab(notes):
    lowest = F.min_by(F.struct("string", "fret"), "fret").alias("p")
    able = tab_ops.playable(notes.where(F.col("note_idx") % 5 != 0))
    return able.groupBy("clip_id", "onset12", "pitch").agg(lowest).select(
        "clip_id", "onset12", "pitch", "p.string", "p.fret"
    )


@query(
    "j17_playable_positions",
    with_roles(
        "candidates", "SELECT clip_id, note_idx, string, fret FROM candidates", recursive=True
    ),
)
def playable_positions(r: Roles):
    return tab_ops.playable(score(r)[0]).select("clip_id", "note_idx", "string", "fret")


@query(
    "a22_position_costs",
    with_roles(
        "stringed",
        """WITH c AS (SELECT pitch, string, count(*) AS n FROM stringed GROUP BY 1, 2),
          b AS (SELECT 6 - i AS string, o, f AS fret, o + f AS pitch FROM (SELECT
            unnest([0, 1, 2, 3, 4, 5]) AS i, unnest([40, 45, 50, 55, 59, 64]) AS o), range(0, 25) t(f))
        SELECT (6 - b.string)::INT AS string_index, b.fret::INT AS fret, round(-ln((coalesce(c.n, 0)
            + 1.0::DOUBLE) / (SELECT sum(coalesce(c2.n, 0) + 1.0::DOUBLE) FROM b b2 LEFT JOIN c c2
              ON c2.pitch = b2.pitch AND c2.string = b2.string WHERE b2.pitch = b.pitch)), 6) AS cost
        FROM b LEFT JOIN c ON c.pitch = b.pitch AND c.string = b.string""",
    ),
)
def position_costs(r: Roles):
    costs = tab_ops.position_costs(tab_ops.string_counts(stringed(r)))
    return costs.select("string_index", "fret", F.round("cost", 6).alias("cost"))


add_role(
    "shapes",
    "score",
    """SELECT DISTINCT pitches FROM (SELECT list_sort(list_distinct(list(pitch))) AS pitches
       FROM score GROUP BY clip_id, onset12)""",
)
# every way to play a shape, built note by note; "6" in a path leaves a note out
add_role(
    "ways",
    "shapes",
    """SELECT pitches, 0 AS i, '' AS path, []::BIGINT[] AS frets, 0 AS dropped FROM shapes
       UNION ALL
       SELECT pitches, i + 1, path || s, CASE WHEN s < 6 AND fret > 0 THEN list_append(frets, fret)
           ELSE frets END, dropped + CASE WHEN s = 6 THEN 1 ELSE 0 END
       FROM (SELECT w.*, s, CASE WHEN s < 6 THEN pitches[i + 1] - ([40, 45, 50, 55, 59, 64])[s + 1]
               END AS fret FROM ways w, range(0, 7) t(s) WHERE i < len(pitches))
       WHERE s = 6 OR (fret BETWEEN 0 AND 24 AND NOT contains(path, s::VARCHAR))""",
)


@query(
    "t5_cheapest_fingerings",
    with_roles(
        "ways",
        """WITH c AS (SELECT array_to_string(pitches, ',') AS pitches, path,
            50 * dropped + coalesce(list_max(frets) - list_min(frets), 0)
              + 10 * greatest(coalesce(list_max(frets) - list_min(frets), 0) - 4, 0) AS cost
          FROM ways WHERE i = len(pitches))
        SELECT pitches, (row_number() OVER (PARTITION BY pitches ORDER BY cost, path) - 1)::INT AS rank,
          cost::DOUBLE AS cost, path FROM c
        QUALIFY row_number() OVER (PARTITION BY pitches ORDER BY cost, path) <= 64""",
        recursive=True,
    ),
)
def cheapest_fingerings(r: Roles):
    ways = tab_ops.fingerings(tab_ops.chords(score(r)[0]), None)
    rows = ways.select("pitches", F.posexplode("ways").alias("rank", "way"))
    path = F.array_join(
        F.transform(
            "way.places",
            lambda p: F.when(p < 0, "6").otherwise(F.floor(p / 64).cast("string")),
        ),
        "",
    )
    return rows.select(
        F.array_join(F.col("pitches").cast("array<string>"), ",").alias("pitches"),
        "rank",
        F.col("way.cost").alias("cost"),
        path.alias("path"),
    )


@query("w24_tab_positions")
def tab_positions(r: Roles):
    costs = tab_ops.position_costs(tab_ops.string_counts(stringed(r)))
    return tab_ops.assign_tab(score(r)[0], costs)


@query(
    "w24_path_costs",
    with_roles(
        "ways score",
        """WITH priced AS (SELECT pitches, frets, 50 * dropped
            + coalesce(list_max(frets) - list_min(frets), 0)
            + 10 * greatest(coalesce(list_max(frets) - list_min(frets), 0) - 4, 0) AS cost
          FROM ways WHERE i = len(pitches)
          QUALIFY row_number() OVER (PARTITION BY pitches ORDER BY cost, path) <= 64),
        hands AS (SELECT pitches, h, min(cost) AS cost FROM priced, range(1, 25) t(h)
          WHERE CASE WHEN len(frets) = 0 THEN true
            WHEN list_max(frets) - list_min(frets) > 4 THEN h = list_min(frets)
            ELSE h BETWEEN greatest(list_max(frets) - 4, 1) AND list_min(frets) END GROUP BY ALL),
        played AS (SELECT clip_id, pitches, row_number() OVER (PARTITION BY clip_id ORDER BY onset12) AS i
          FROM (SELECT clip_id, onset12, list_sort(list_distinct(list(pitch))) AS pitches FROM score
            GROUP BY 1, 2)),
        walk AS (SELECT clip_id, i, h, cost FROM played JOIN hands USING (pitches) WHERE i = 1
          UNION ALL
          SELECT w.clip_id, p.i, n.h, min(w.cost + n.cost + CASE WHEN w.h = n.h THEN 0
            ELSE 4 + abs(w.h - n.h) END)
          FROM walk w JOIN played p ON p.clip_id = w.clip_id AND p.i = w.i + 1
          JOIN hands n ON n.pitches = p.pitches GROUP BY w.clip_id, p.i, n.h)
        SELECT clip_id, min(cost)::DOUBLE AS cost FROM walk
        WHERE (clip_id, i) IN (SELECT (clip_id, max(i)) FROM played GROUP BY clip_id) GROUP BY 1""",
        recursive=True,
    ),
)
def path_costs(r: Roles):
    return tab_ops.path_costs(score(r)[0], None)


@query(
    "j18_placed_notes",
    with_roles(
        "placed_score",
        "SELECT clip_id, note_idx, string, fret FROM placed_score",
        recursive=True,
    ),
)
def placed_notes(r: Roles):
    notes = score(r)[0]
    return tab_ops.placed_notes(notes, simple_tab(notes)).select("clip_id", "note_idx", "string", "fret")


@query(
    "a36_unplayable_counts",
    with_roles(
        "score simple_tab",
        """SELECT s.clip_id, count(*) FILTER (t.pitch IS NULL) AS unplayable FROM score s
        LEFT JOIN simple_tab t USING (clip_id, onset12, pitch) GROUP BY 1""",
        recursive=True,
    ),
)
def unplayable_counts(r: Roles):
    notes = score(r)[0]
    return tab_ops.unplayable_counts(notes, simple_tab(notes))


# --- matching ---


def _walk_roles(name: str, truth: str, found: str, keys: str, time: str, tolerance: int) -> None:
    """Two pointers moved down both sorted sides, one comparison per step."""
    both = ", ".join(f"w.{x.strip()}" for x in keys.split(","))
    on = " AND ".join(f"{{0}}.{x.strip()} = w.{x.strip()}" for x in keys.split(","))
    for side, table in (("t", truth), ("f", found)):
        add_role(
            f"{name}_{side}",
            table,
            f"""SELECT {keys}, {time} AS at_t, note_idx, row_number() OVER (PARTITION BY {keys}
                ORDER BY {time}, note_idx) AS i FROM {table}""",
        )
    add_role(
        f"{name}_walk",
        f"{name}_t {name}_f",
        f"""SELECT {keys}, 1 AS a, 1 AS b, NULL::BIGINT AS truth_id, NULL::BIGINT AS found_id
            FROM (SELECT DISTINCT {keys} FROM {name}_t)
          UNION ALL
          SELECT {both}, CASE WHEN abs(f.at_t - t.at_t) <= {tolerance} OR f.at_t > t.at_t THEN a + 1
              ELSE a END, CASE WHEN abs(f.at_t - t.at_t) <= {tolerance} OR f.at_t < t.at_t THEN b + 1
              ELSE b END,
            CASE WHEN abs(f.at_t - t.at_t) <= {tolerance} THEN t.note_idx END,
            CASE WHEN abs(f.at_t - t.at_t) <= {tolerance} THEN f.note_idx END
          FROM {name}_walk w JOIN {name}_t t ON {on.format('t')} AND t.i = w.a
            JOIN {name}_f f ON {on.format('f')} AND f.i = w.b""",
    )
    add_role(
        name,
        f"{name}_walk",
        f"SELECT {keys}, truth_id, found_id FROM {name}_walk WHERE truth_id IS NOT NULL",
    )


_walk_roles("pairs", "annotated", "notes", "clip_id, pitch", "onset", 500)
_walk_roles("score_pairs", "annotated", "score", "clip_id, pitch", "onset", 500)
_walk_roles("placed_pairs", "stringed", "placed_score", "clip_id, pitch", "onset", 500)
add_role("true_beats", "beats", "SELECT clip_id, beat AS note_idx, tick FROM beats")
add_role(
    "found_beats",
    "beats",
    """SELECT clip_id, beat AS note_idx, tick + (beat * 13 % 7 - 3) * 300 AS tick FROM beats
       WHERE beat % 9 <> 4""",
)
_walk_roles("beat_pairs", "true_beats", "found_beats", "clip_id", "tick", 700)


def found_beats(r: Roles):
    b = r.beats().where(F.col("beat") % 9 != 4)
    return b.select("clip_id", "beat", (F.col("tick") + (F.col("beat") * 13 % 7 - 3) * 300).alias("tick"))


@query(
    "j11_matched_notes",
    with_roles("pairs", "SELECT clip_id, pitch, truth_id, found_id FROM pairs", recursive=True),
)
def matched_notes(r: Roles):
    return ops.note_pairs(r.annotated(), r.notes())


@query("j11_matched_with_offsets")
def matched_with_offsets(r: Roles):
    return matching.matched_with_offsets(r.annotated(), r.notes())


_SCORES = """WITH t AS (SELECT clip_id, count(*) AS t FROM annotated GROUP BY 1),
    f AS (SELECT clip_id, count(*) AS f FROM notes GROUP BY 1),
    m AS (SELECT clip_id, count(*) AS m FROM pairs GROUP BY 1),
    s AS (SELECT clip_id, coalesce(m, 0) / f::DOUBLE AS note_precision,
        coalesce(m, 0) / t::DOUBLE AS note_recall
      FROM t JOIN f USING (clip_id) LEFT JOIN m USING (clip_id))
  SELECT clip_id, note_precision, note_recall, CASE WHEN note_precision + note_recall > 0 THEN
    2 * note_precision * note_recall / (note_precision + note_recall) ELSE 0 END AS note_f1 FROM s"""
add_role("note_metrics", "annotated notes pairs", _SCORES)


@query(
    "a23_note_scores",
    with_roles(
        "note_metrics",
        """SELECT clip_id, round(note_precision, 9) AS note_precision,
          round(note_recall, 9) AS note_recall, round(note_f1, 9) AS note_f1 FROM note_metrics""",
        recursive=True,
    ),
)
def note_scores(r: Roles):
    s = ops.note_scores(r.annotated(), r.notes()).drop("note_f1_with_offsets")
    return s.select("clip_id", *[F.round(c, 9).alias(c) for c in s.columns[1:]])


@query("a23_note_scores_with_offsets")
def note_scores_with_offsets(r: Roles):
    return ops.note_scores(r.annotated(), r.notes()).select("clip_id", "note_f1_with_offsets")


add_role(
    "beat_metrics",
    "true_beats found_beats beat_pairs",
    """SELECT clip_id, CASE WHEN m > 0 THEN 2 * (m / f::DOUBLE) * (m / t::DOUBLE)
         / ((m / f::DOUBLE) + (m / t::DOUBLE)) ELSE 0 END AS beat_f
       FROM (SELECT clip_id, count(*) AS t FROM true_beats GROUP BY 1)
       JOIN (SELECT clip_id, count(*) AS f FROM found_beats GROUP BY 1) USING (clip_id)
       JOIN (SELECT clip_id, count(*) AS m FROM beat_pairs GROUP BY 1) USING (clip_id)""",
)


@query(
    "a24_beat_scores",
    with_roles("beat_metrics", "SELECT clip_id, round(beat_f, 9) AS beat_f FROM beat_metrics", recursive=True),
)
def beat_scores(r: Roles):
    s = ops.beat_scores(r.beats(), found_beats(r), "beat_f")
    return s.withColumn("beat_f", F.round("beat_f", 9))


@query(
    "a24_tempo_correct",
    with_roles(
        "beats found_beats",
        """WITH t AS (SELECT clip_id, 60 / (quantile_cont(d, 0.5) / 10000.0::DOUBLE) AS bpm FROM (SELECT
            clip_id, tick - lag(tick) OVER (PARTITION BY clip_id ORDER BY beat) AS d FROM beats)
            WHERE d IS NOT NULL GROUP BY 1),
          f AS (SELECT clip_id, 60 / (quantile_cont(d, 0.5) / 10000.0::DOUBLE) AS bpm FROM (SELECT
            clip_id, tick - lag(tick) OVER (PARTITION BY clip_id ORDER BY note_idx) AS d
            FROM found_beats) WHERE d IS NOT NULL GROUP BY 1)
        SELECT clip_id, (abs(f.bpm / t.bpm - 1) <= 0.04)::INT::DOUBLE AS tempo_correct
        FROM t JOIN f USING (clip_id)""",
    ),
)
def tempo_correct(r: Roles):
    return ops.tempo_correct(timeline.tempo(r.beats()), timeline.tempo(found_beats(r)))


_POSITIONS = f"""WITH d AS (SELECT clip_id, min(beat) FILTER ((beat + clip_id) % 4 = 0) AS first_bar
      FROM beats GROUP BY 1),
    q AS (SELECT p.clip_id, p.truth_id, b.truth_pos - first_bar AS a,
        s.onset12 / 12.0::DOUBLE - pickup AS w
      FROM score_pairs p JOIN score s ON s.clip_id = p.clip_id AND s.note_idx = p.found_id
        JOIN ({_beat_of('truth_pos', 'onset', 'annotated')}) b ON b.clip_id = p.clip_id
          AND b.note_idx = p.truth_id
        JOIN numbering n ON n.clip_id = p.clip_id JOIN d ON d.clip_id = p.clip_id),
    e AS (SELECT clip_id, abs(a - w) % 1 AS d1, abs(a - w) % 4 AS d4 FROM q)
  SELECT clip_id, round(count(*) FILTER (least(d1, 1 - d1) <= 0.125) / count(*)::DOUBLE, 9)
      AS notes_on_beat,
    round(count(*) FILTER (least(d4, 4 - d4) <= 0.125) / count(*)::DOUBLE, 9) AS notes_in_bar
  FROM e GROUP BY 1"""


@query(
    "a25_position_scores",
    with_roles("score_pairs score annotated spans numbering beats", _POSITIONS, recursive=True),
)
def position_scores(r: Roles):
    notes, numbers = score(r)
    truth = r.annotated()
    sliced = timeline.sliced_spans(timeline.beat_spans(r.beats()), timeline.reach_of(truth))
    first = (
        r.beats()
        .where((F.col("beat") + F.col("clip_id")) % 4 == 0)
        .groupBy("clip_id")
        .agg(F.min("beat").alias("first_bar"))
    )
    placed = timeline.to_beats(truth, sliced, "onset", "truth_pos").select(
        "clip_id", F.col("note_idx").alias("truth_id"), "truth_pos"
    )
    written = notes.select("clip_id", F.col("note_idx").alias("found_id"), "onset12")
    pairs = (
        ops.note_pairs(truth, notes)
        .join(placed, ["clip_id", "truth_id"])
        .join(written, ["clip_id", "found_id"])
        .join(numbers, "clip_id")
        .join(first, "clip_id")
        .select(
            "clip_id",
            (F.col("truth_pos") - F.col("first_bar")).alias("truth_beat"),
            (F.col("onset12") / 12 - F.col("pickup")).alias("written_beat"),
        )
    )
    s = ops.position_scores(pairs)
    return s.select("clip_id", *[F.round(c, 9).alias(c) for c in s.columns[1:]])


# --- the player's chords ---

add_role(
    "ordered_truth",
    "annotated",
    """SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY onset, pitch, note_idx) AS i
       FROM annotated""",
)
add_role(
    "truth_events",
    "ordered_truth",
    """SELECT clip_id, i, note_idx, onset, onset AS opened, note_idx AS event, [pitch] AS pitches
         FROM ordered_truth WHERE i = 1
       UNION ALL
       SELECT clip_id, i, note_idx, onset, CASE WHEN joins THEN p_opened ELSE onset END,
         CASE WHEN joins THEN p_event ELSE note_idx END,
         CASE WHEN joins THEN list_append(p_pitches, pitch) ELSE [pitch] END
       FROM (SELECT n.*, e.opened AS p_opened, e.event AS p_event, e.pitches AS p_pitches,
           n.onset - e.onset <= 1000 AND n.onset - e.opened <= 2500
             AND NOT list_contains(e.pitches, n.pitch) AS joins
         FROM truth_events e JOIN ordered_truth n ON n.clip_id = e.clip_id AND n.i = e.i + 1)""",
)


@query(
    "w11_played_events",
    with_roles("truth_events", "SELECT clip_id, note_idx, event FROM truth_events", recursive=True),
)
def played_events(r: Roles):
    return ops.played_events(r.annotated()).select("clip_id", "note_idx", "event")


_GROUPING = """WITH g AS (SELECT t.clip_id, t.event, min(t.i) AS place, count(*) AS notes,
      count(s.onset12) AS found, list_distinct(list(s.onset12) FILTER (s.onset12 IS NOT NULL)) AS pos,
      min(t.onset) AS first, max(t.onset) AS last
    FROM truth_events t LEFT JOIN score_pairs p ON p.clip_id = t.clip_id AND p.truth_id = t.note_idx
      LEFT JOIN score s ON s.clip_id = p.clip_id AND s.note_idx = p.found_id GROUP BY 1, 2),
  n AS (SELECT *, lead(first) OVER w AS next_first, lead(pos) OVER w AS next_pos FROM g
    WINDOW w AS (PARTITION BY clip_id ORDER BY place))
  SELECT clip_id, coalesce(round(count(*) FILTER (notes >= 3 AND found >= 2 AND len(pos) = 1)
      / nullif(count(*) FILTER (notes >= 3 AND found >= 2), 0)::DOUBLE, 9), -1) AS chords_whole,
    coalesce(round(count(*) FILTER (len(pos) > 0 AND len(next_pos) > 0 AND next_first - last >= 1000
        AND NOT list_has_any(pos, next_pos))
      / nullif(count(*) FILTER (len(pos) > 0 AND len(next_pos) > 0 AND next_first - last >= 1000), 0)
        ::DOUBLE, 9), -1) AS notes_apart FROM n GROUP BY 1"""


@query(
    "a26_grouping_scores",
    with_roles("truth_events score_pairs score", _GROUPING, recursive=True),
)
def grouping_scores(r: Roles):
    notes = score(r)[0]
    truth = r.annotated()
    written = (
        ops.note_pairs(truth, notes)
        .join(notes.select("clip_id", F.col("note_idx").alias("found_id"), "onset12"), ["clip_id", "found_id"])
        .select("clip_id", F.col("truth_id").alias("note_idx"), "onset12")
    )
    s = ops.grouping_scores(ops.played_events(truth), written)
    return s.select(
        "clip_id", *[F.coalesce(F.round(c, 9), F.lit(-1.0)).alias(c) for c in s.columns[1:]]
    )


@query(
    "a27_string_accuracy",
    with_roles(
        "placed_pairs stringed placed_score",
        """SELECT t.clip_id, round(coalesce(any_value(a), 0), 9) AS tab_string_accuracy
        FROM (SELECT DISTINCT clip_id FROM stringed) t LEFT JOIN (SELECT p.clip_id,
            count(*) FILTER (o.string = s.string) / count(*)::DOUBLE AS a
          FROM placed_pairs p JOIN stringed o ON o.clip_id = p.clip_id AND o.note_idx = p.truth_id
            JOIN placed_score s ON s.clip_id = p.clip_id AND s.note_idx = p.found_id GROUP BY 1) q
          ON q.clip_id = t.clip_id GROUP BY 1""",
        recursive=True,
    ),
)
def string_accuracy(r: Roles):
    notes = score(r)[0]
    s = ops.string_accuracy(stringed(r), tab_ops.placed_notes(notes, simple_tab(notes)))
    return s.withColumn("tab_string_accuracy", F.round("tab_string_accuracy", 9))


# --- metric tables ---

add_role(
    "metrics",
    "note_metrics beat_metrics",
    """SELECT clip_id, (['duo', 'solo', 'keys'])[clip_id % 3 + 1] AS suite, metric, value FROM (
         SELECT clip_id, 'note_f1' AS metric, note_f1 AS value FROM note_metrics UNION ALL
         SELECT clip_id, 'note_recall', note_recall FROM note_metrics UNION ALL
         SELECT clip_id, 'beat_f', beat_f FROM beat_metrics WHERE clip_id % 4 <> 1)""",
)
add_role(
    "baseline",
    "metrics",
    "SELECT clip_id, metric, value + (clip_id % 5 - 2) * 0.02::DOUBLE AS value FROM metrics",
)


def metrics(r: Roles):
    """Metric rows per clip; some clips have no beats annotated."""
    notes = ops.note_scores(r.annotated(), r.notes()).select("clip_id", "note_f1", "note_recall")
    beat = ops.beat_scores(r.beats(), found_beats(r), "beat_f").where(F.col("clip_id") % 4 != 1)
    rows = ops.to_long(notes).unionByName(ops.to_long(beat))
    suites = F.array(F.lit("duo"), F.lit("solo"), F.lit("keys"))
    return rows.withColumn("suite", F.element_at(suites, (F.col("clip_id") % 3 + 1).cast("int")))


def baseline(rows):
    return rows.withColumn("value", F.col("value") + (F.col("clip_id") % 5 - 2) * F.lit(0.02))


@query(
    "a29_suite_means",
    with_roles(
        "metrics",
        """SELECT suite, metric, round_even((sum(round_even(value, 9)::DECIMAL(28, 9)) / count(*))::DOUBLE,
          4) AS mean, count(*) AS clips FROM metrics GROUP BY 1, 2""",
        recursive=True,
    ),
)
def suite_means(r: Roles):
    return ops.suite_means(metrics(r))


@query(
    "a30_regressions",
    with_roles(
        "metrics baseline",
        """SELECT clip_id, metric, round(m.value, 6) AS value, round(b.value, 6) AS expected
        FROM metrics m JOIN baseline b USING (clip_id, metric)
        WHERE m.value < b.value - 0.025::DOUBLE""",
        recursive=True,
    ),
)
def regressions(r: Roles):
    rows = settle(metrics(r), "metrics")
    found = ops.regressions(rows, baseline(rows))
    return found.withColumn("value", F.round("value", 6)).withColumn("expected", F.round("expected", 6))


@query(
    "s11_metric_report",
    with_roles(
        "metrics",
        """SELECT clip_id, coalesce(max(printf('%.3f', round_even(value, 3))) FILTER (metric = 'note_f1'), '') AS note_f1,
          coalesce(max(printf('%.3f', round_even(value, 3))) FILTER (metric = 'note_recall'), '') AS note_recall,
          coalesce(max(printf('%.3f', round_even(value, 3))) FILTER (metric = 'beat_f'), '') AS beat_f
        FROM metrics GROUP BY 1""",
        recursive=True,
    ),
)
def metric_report(r: Roles):
    return ops.report(metrics(r), ["note_f1", "note_recall", "beat_f"])


_CELLS = ", ".join(
    f"coalesce(max(printf('%.3f', round_even(value, 3))) FILTER (metric = '{m}'), '') AS {m}"
    for m in ("note_f1", "note_recall", "beat_f")
)


@query(
    "s11_report_with_means",
    with_roles(
        "metrics",
        f"""SELECT 'clip' AS kind, clip_id::VARCHAR AS name, {_CELLS} FROM metrics GROUP BY clip_id
        UNION ALL SELECT 'mean', suite, {_CELLS} FROM (SELECT suite, metric,
          round_even((sum(round_even(value, 9)::DECIMAL(28, 9)) / count(*))::DOUBLE, 4) AS value
          FROM metrics GROUP BY 1, 2) GROUP BY suite""",
        recursive=True,
    ),
)
def report_with_means(r: Roles):
    return ops.report_with_means(settle(metrics(r), "metrics"), ["note_f1", "note_recall", "beat_f"])


@query(
    "s12_gate_on_files",
    with_roles(
        "metrics baseline",
        """SELECT clip_id, metric, round(m.value, 6) AS value, round(b.value, 6) AS expected
        FROM metrics m JOIN baseline b USING (clip_id, metric)
        WHERE m.value < b.value - 0.015::DOUBLE""",
        recursive=True,
    ),
)
def gate_on_files(r: Roles):
    """The gate against a baseline that was written with its tolerance and read again."""
    rows, path = settle(metrics(r), "metrics"), scratch_path(r.spark, "baseline")
    ops.write_baseline(ops.baseline_rows(baseline(rows), "1.4+abc", 0.015), path)
    found = ops.gate(rows, ops.read_baseline_file(r.spark, path))
    return found.withColumn("value", F.round("value", 6)).withColumn("expected", F.round("expected", 6))


@query(
    "s12_baseline_round_trip",
    with_roles(
        "metrics",
        "SELECT clip_id, metric, round(value, 9) AS value FROM metrics",
        recursive=True,
    ),
)
def baseline_round_trip(r: Roles):
    """Baselines written as JSON text and read back."""
    stored = ops.baseline_documents(metrics(r).withColumn("value", F.round("value", 9)))
    return ops.read_baseline(stored)


# --- tuning ---

SETTINGS = [(f"bass {w:g}", w) for w in (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0, 1.5, 2.0, 3.0)]
add_role(
    "tuned",
    "chroma templates",
    """WITH p AS (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0, 1.5, 2.0, 3.0]::DOUBLE[])
           AS w, unnest(['bass 0', 'bass 0.1', 'bass 0.2', 'bass 0.3', 'bass 0.4', 'bass 0.5',
             'bass 0.6', 'bass 0.8', 'bass 1', 'bass 1.5', 'bass 2', 'bass 3']) AS setting),
         t AS (SELECT clip_id, span, sqrt(sum(c * c)) AS norm, sum(b) AS bass FROM chroma GROUP BY 1, 2),
         m AS (SELECT clip_id, span, state, any_value(root) AS root, sum(c) / any_value(size) AS hit
           FROM chroma JOIN templates USING (pc) GROUP BY 1, 2, 3),
         s AS (SELECT m.clip_id, m.span, setting, arg_max(state, (hit / greatest(norm, 1e-9) + w * r.b
             / greatest(bass, 1e-9), -state)) AS state
           FROM m JOIN t USING (clip_id, span) JOIN chroma r ON r.clip_id = m.clip_id
             AND r.span = m.span AND r.pc = m.root, p GROUP BY 1, 2, 3)
       SELECT clip_id, setting, CASE WHEN clip_id % 2 = 0 THEN 'comp' ELSE 'solo' END AS mode,
         count(*) FILTER ((state // 5 + span) % 3 = 0) / count(*)::DOUBLE AS score
       FROM s GROUP BY 1, 2""",
)
add_role(
    "setting_means",
    "tuned",
    """SELECT setting, round((c + s) / 2, 6) AS mean, round(c, 6) AS comp, round(s, 6) AS solo FROM (
         SELECT setting, avg(score) FILTER (mode = 'comp') AS c, avg(score) FILTER (mode = 'solo') AS s
         FROM tuned GROUP BY 1)""",
)


def tuned(r: Roles):
    """Score of each chord setting on each clip; the chroma is computed once for all settings."""
    candidates = ops.with_candidates(settle(chroma(r), "chroma"), SETTINGS)
    scored = harmony.chord_scores(candidates, F.col("parameter"), ["setting"])
    best = harmony.best_template(scored.withColumn("silent", F.lit(False)), ["setting"])
    right = (F.expr(f"state div {len(harmony.QUALITIES)}") + F.col("span")) % 3 == 0
    return best.groupBy("clip_id", "setting").agg(
        F.when(F.col("clip_id") % 2 == 0, "comp").otherwise("solo").alias("mode"),
        (F.count_if(right) / F.count(F.lit(1))).alias("score"),
    )


@query(
    "j22_setting_scores",
    with_roles("tuned", "SELECT clip_id, setting, mode, round(score, 9) AS score FROM tuned"),
)
def setting_scores(r: Roles):
    return tuned(r).withColumn("score", F.round("score", 9))


@query("a31_setting_means", with_roles("setting_means", "SELECT * FROM setting_means"))
def setting_means(r: Roles):
    return ops.setting_means(tuned(r))


@query(
    "t3_best_settings",
    with_roles(
        "setting_means",
        """SELECT * FROM setting_means WHERE solo >= 0.3::DOUBLE - 0.1::DOUBLE
        ORDER BY mean DESC, setting LIMIT 10""",
    ),
)
def best_settings(r: Roles):
    return ops.best_settings(ops.setting_means(tuned(r)), today=0.3, max_loss=0.1)


# --- edits ---

add_role(
    "edit_rows",
    "messages gridded",
    """SELECT m.user_id AS doc_id, k % 10 AS list_id, event_id AS seq,
         (['delete', 'set_pitch', 'set_duration', 'add', 'set_duration'])[event_id % 5 + 1] AS op,
         g.onset12, g.pitch FROM messages m JOIN gridded g ON g.note_idx = m.event_id
       WHERE event_type <> 'error'""",
)


def edit_rows(r: Roles, gridded):
    """Edits derived from the notes: each points at where its own note was written."""
    written = gridded.select(F.col("note_idx").alias("event_id"), "onset12", "pitch")
    kinds = F.array(*map(F.lit, ["delete", "set_pitch", "set_duration", "add", "set_duration"]))
    m = r.messages().where(F.col("event_type") != "error")
    op = F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int"))
    return m.join(written, "event_id").select(
        F.col("user_id").alias("doc_id"),
        (F.col("k") % 10).alias("list_id"),
        F.col("event_id").alias("seq"),
        op.alias("op"),
        F.when(op == "add", F.col("onset12") + 1).otherwise(F.col("onset12")).alias("onset12"),
        "pitch",
        (F.col("pitch") + 1).alias("new_pitch"),
        (F.col("event_id") % 24 + 1).alias("duration12"),
        F.lit(None).cast("int").alias("string"),
        F.lit(None).cast("int").alias("fret"),
    )


# Edits replayed list by list: the notes a list holds after each of its edits, one set per step.
add_role(
    "numbered_edits",
    "edit_rows",
    """SELECT doc_id, list_id, op, pitch, CASE WHEN op = 'add' THEN onset12 + 1 ELSE onset12 END AS onset12,
         seq % 24 + 1 AS duration12,
         row_number() OVER (PARTITION BY doc_id, list_id ORDER BY seq) AS i FROM edit_rows""",
)
add_role(
    "edit_steps",
    "numbered_edits merged",
    """SELECT l.doc_id, l.list_id, 0 AS i, NULL::VARCHAR AS reason, coalesce(list({'o': m.onset12, 'p': m.pitch,
           'd': m.duration12, 's': m.onset, 'e': m."offset"}) FILTER (m.pitch IS NOT NULL), []) AS held
       FROM (SELECT DISTINCT doc_id, list_id FROM numbered_edits) l
       LEFT JOIN merged m ON m.clip_id = l.doc_id GROUP BY 1, 2
       UNION ALL
       SELECT doc_id, list_id, i, reason, CASE
         WHEN op = 'add' THEN list_append(held,
           {'o': onset12, 'p': pitch, 'd': duration12, 's': NULL::BIGINT, 'e': NULL::BIGINT})
         WHEN op = 'delete' THEN list_filter(held, lambda n: n.o <> onset12 OR n.p <> pitch)
         WHEN op = 'set_pitch' THEN list_transform(held, lambda n: CASE WHEN n.o = onset12 AND n.p = pitch
           THEN {'o': n.o, 'p': n.p + 1, 'd': n.d, 's': n.s, 'e': n.e} ELSE n END)
         ELSE list_transform(held, lambda n: CASE WHEN n.o = onset12 AND n.p = pitch
           THEN {'o': n.o, 'p': n.p, 'd': duration12, 's': n.s, 'e': NULL::BIGINT} ELSE n END) END
       FROM (SELECT e.*, s.held, CASE
             WHEN op <> 'add' AND len(list_filter(held, lambda n: n.o = onset12 AND n.p = pitch)) = 0
               THEN 'absent'
             WHEN op = 'add' AND len(list_filter(held, lambda n: n.o = onset12 AND n.p = pitch)) > 0
               THEN 'occupied'
             WHEN op = 'set_pitch' AND len(list_filter(held, lambda n: n.o = onset12 AND n.p = pitch + 1)) > 0
               THEN 'occupied' END AS reason
           FROM edit_steps s JOIN numbered_edits e
             ON e.doc_id = s.doc_id AND e.list_id = s.list_id AND e.i = s.i + 1 WHERE s.reason IS NULL)""",
)


@query(
    "u4_replayed_edits",
    with_roles(
        "edit_steps numbered_edits",
        """WITH done AS (SELECT * FROM edit_steps
          QUALIFY row_number() OVER (PARTITION BY doc_id, list_id ORDER BY i DESC) = 1)
        SELECT doc_id, list_id, n.o AS onset12, n.p AS pitch, n.d AS duration12, NULL::INT AS string,
          NULL::INT AS fret, NULL::INT AS rejected_at, NULL::VARCHAR AS reason
        FROM (SELECT doc_id, list_id, unnest(held) AS n FROM done WHERE reason IS NULL)
        UNION ALL
        SELECT doc_id, list_id, NULL, NULL, NULL, NULL, NULL, i::INT, reason FROM done
        WHERE reason IS NOT NULL""",
        recursive=True,
    ),
)
def replayed_edits(r: Roles):
    return replayed_lists(r).drop("velocity", "onset", "offset")


def replayed_lists(r: Roles):
    written = settle(gridded(r), "gridded")
    merged = settle(rhythm.merge_duplicates(rhythm.with_durations(written)), "merged")
    nothing = F.lit(None).cast("int")
    base = merged.select(
        F.col("clip_id").alias("doc_id"), "onset12", "pitch", "duration12",
        nothing.alias("string"), nothing.alias("fret"), "onset", "offset",
    )
    return edit_ops.replay(base, edit_rows(r, written))


@query(
    "u4_edited_times",
    with_roles(
        "edit_steps numbered_edits beats",
        """WITH done AS (SELECT * FROM edit_steps
          QUALIFY row_number() OVER (PARTITION BY doc_id, list_id ORDER BY i DESC) = 1),
        kept AS (SELECT doc_id, list_id, unnest(held) AS n FROM done WHERE reason IS NULL),
        beat_gaps AS (SELECT clip_id, beat, tick AS t0, lead(tick) OVER (PARTITION BY clip_id ORDER BY beat) AS t1
          FROM beats),
        beat_steps AS (SELECT * FROM beat_gaps WHERE t1 IS NOT NULL
          UNION ALL SELECT c.doc_id, 0, coalesce(min(b.tick), 0), coalesce(min(b.tick), 0) + 5000
          FROM (SELECT DISTINCT doc_id FROM kept) c LEFT JOIN beats b ON b.clip_id = c.doc_id
          GROUP BY 1 HAVING count(b.tick) < 2),
        step_ends AS (SELECT clip_id, min(beat) AS first, max(beat) AS last FROM beat_steps GROUP BY 1),
        ends AS (SELECT k.*, least(greatest(floor(n.o / 12), first), last)::BIGINT AS b0,
            least(greatest(floor((n.o + n.d) / 12), first), last)::BIGINT AS b1
          FROM kept k JOIN step_ends ON clip_id = doc_id)
        SELECT doc_id, list_id, n.o AS onset12, n.p AS pitch, n.d AS duration12,
          coalesce(n.s, greatest(0, x.t0 + floor((n.o - b0 * 12) * (x.t1 - x.t0) / 12 + 0.5))::BIGINT) AS onset,
          coalesce(n.e, greatest(0, y.t0 + floor((n.o + n.d - b1 * 12) * (y.t1 - y.t0) / 12 + 0.5))::BIGINT)
            AS "offset"
        FROM ends JOIN beat_steps x ON x.clip_id = doc_id AND x.beat = b0
          JOIN beat_steps y ON y.clip_id = doc_id AND y.beat = b1""",
        recursive=True,
    ),
)
def edited_times(r: Roles):
    """When the notes of accepted lists sound: as recorded, or by the beats where an edit made the time."""
    kept = replayed_lists(r).where("reason is null")
    timed = edit_ops.with_times(kept, r.beats())
    return timed.select("doc_id", "list_id", "onset12", "pitch", "duration12", "onset", "offset")


@query(
    "u4_compacted_edits",
    with_roles(
        "edit_rows",
        """SELECT doc_id, list_id, seq, op FROM edit_rows WHERE op = 'add' UNION ALL
        SELECT doc_id, list_id, seq, op FROM edit_rows WHERE op <> 'add'
        QUALIFY row_number() OVER (PARTITION BY doc_id, list_id, onset12, pitch ORDER BY seq DESC) = 1""",
        recursive=True,
    ),
)
def compacted_edits(r: Roles):
    return edit_ops.compact(edit_rows(r, gridded(r))).select("doc_id", "list_id", "seq", "op")


@query(
    "f21_grid_checks",
    with_roles(
        "timed",
        """SELECT clip_id, note_idx, onset12 % 3 = 0 OR onset12 % 4 = 0 AS on_grid,
          duration12 <= 768 AS short_enough FROM timed""",
        recursive=True,
    ),
)
def grid_checks(r: Roles):
    timed = rhythm.with_durations(gridded(r))
    on_grid = (F.pmod("onset12", F.lit(3)) == 0) | (F.pmod("onset12", F.lit(4)) == 0)
    longest = k.MAX_NOTE_BEATS * k.DIVISIONS
    return timed.select(
        "clip_id", "note_idx", on_grid.alias("on_grid"), (F.col("duration12") <= longest).alias("short_enough")
    )


# --- incremental steps ---


def _nothing(inputs):
    raise NotImplementedError


def steps() -> tuple[incremental.Step, ...]:
    guitar = F.get_json_object("config", "$.instrument") == "guitar"
    return (
        incremental.Step("transcribe", "3", _nothing, ("source",), {"model": "m1"}),
        incremental.Step("quantize", "8", _nothing, ("transcribe",)),
        incremental.Step("tab", "4", _nothing, ("quantize",), applies=guitar),
    )


def units(r: Roles):
    return r.jobs().select(F.col("job_id").alias("unit"), "config", F.col("audio_sha256").alias("source"))


def _key(stage: str, version: str, inputs: str, fp: str = "") -> str:
    config = """'"' || replace(config, '"', '\\"') || '"'"""
    return f"""sha256('{{"config":' || {config} || ',"fingerprint":"{fp}","inputs":"' || {inputs}
      || '","stage":"{stage}","version":"{version}"}}')"""


add_role(
    "unit_keys",
    "jobs",
    f"""SELECT unit, t AS transcribe, q AS quantize, CASE WHEN guitar THEN
          {_key('tab', '4', "'quantize=' || q")} END AS tab FROM (
        SELECT *, {_key('quantize', '8', "'transcribe=' || t")} AS q FROM (
          SELECT job_id AS unit, config, json_extract_string(config, '$.instrument') = 'guitar' AS guitar,
            {_key('transcribe', '3', "'source=' || audio_sha256", 'model=m1')} AS t FROM jobs))""",
)
add_role(
    "stage_keys",
    "unit_keys",
    """SELECT unit, 'transcribe' AS stage, transcribe AS cache_key FROM unit_keys UNION ALL
       SELECT unit, 'quantize', quantize FROM unit_keys UNION ALL
       SELECT unit, 'tab', tab FROM unit_keys WHERE tab IS NOT NULL""",
)


@query("f25_stage_cache_keys", with_roles("stage_keys", "SELECT unit, stage, cache_key FROM stage_keys"))
def stage_cache_keys(r: Roles):
    made = steps()
    return incremental.long_keys(incremental.cache_keys(units(r), made), made).drop("place")


@query(
    "u3_pending_steps",
    with_roles(
        "stage_keys",
        """SELECT unit, stage FROM stage_keys WHERE stage = 'tab' OR unit % 4 = 1 OR unit % 7 = 0""",
    ),
)
def pending_steps(r: Roles):
    """What is left to do when most keys are already recorded and tab is forced."""
    made = steps()
    keyed = incremental.cache_keys(units(r), made)
    known = incremental.long_keys(keyed, made).where(F.col("unit") % 4 != 1)
    stale = F.when(F.col("unit") % 7 == 0, "stale").otherwise(F.col("cache_key"))
    manifest = known.withColumn("cache_key", stale)
    return incremental.pending(keyed, manifest, made, force_from="tab").select("unit", "stage")


@query(
    "u1_step_outputs",
    with_roles(
        "notes",
        """SELECT clip_id AS unit, count(*) AS notes, max(pitch) AS highest FROM notes GROUP BY 1""",
    ),
)
def step_outputs(r: Roles):
    """Two chained steps run for the clips whose keys are new, the rest taken from storage."""
    notes = r.notes().withColumnRenamed("clip_id", "unit")
    source = F.sha2(F.col("unit").cast("string"), 256)
    all_units = notes.select("unit").distinct().select(
        "unit", F.lit("{}").alias("config"), source.alias("source")
    )

    def count(inputs):
        return inputs["source"].groupBy("unit").agg(F.count(F.lit(1)).alias("notes"))

    def top(inputs):
        highest = inputs["source"].groupBy("unit").agg(F.max("pitch").alias("highest"))
        return inputs["counted"].join(highest, "unit")

    made = (
        incremental.Step("counted", "1", count, ("source",)),
        incremental.Step("topped", "1", top, ("source", "counted")),
    )
    keyed = incremental.cache_keys(all_units, made)
    manifest = incremental.long_keys(keyed, made).where(F.col("unit") % 2 == 0)
    earlier = {
        "counted": count({"source": notes}).where(F.col("unit") % 2 == 0),
        "topped": top({"source": notes, "counted": count({"source": notes})}).where(
            F.col("unit") % 2 == 0
        ),
    }
    outputs, _ = incremental.recompute(all_units, {"source": notes}, manifest, earlier, made)
    return outputs["topped"]
