"""Frame curves, window stitching, MIDI pairing, loudness and level queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.operators import frames as ops
from tonelake.operators import levels
from tonelake.plans.harmony import frame_times
from tonelake.plans.registry import query
from tonelake.plans.role_sql import add_role, with_roles
from tonelake.sources.roles import Roles

FPS = 22_050 / 256

add_role(
    "rises",
    "frames",
    """SELECT clip_id, frame, sum(round(greatest(0, value - coalesce(before, 0)), 9)::DECIMAL(18, 9))
         ::DOUBLE AS rise FROM (SELECT *, lag(value) OVER (PARTITION BY clip_id, pitch ORDER BY frame)
           AS before FROM frames WHERE pitch BETWEEN 38 AND 80) GROUP BY 1, 2""",
)
add_role(
    "curves",
    "frames",
    """SELECT *, (value * 7) % 1.0::DOUBLE AS offset_value, (value * 3) % 1.0::DOUBLE AS frame_value
       FROM frames""",
)


def curve(r: Roles, factor: int | None = None):
    f = r.frames()
    return f if factor is None else f.withColumn("value", (F.col("value") * factor) % F.lit(1.0))


@query(
    "a21_onset_strength",
    with_roles("rises", "SELECT clip_id, frame, round(rise, 6) AS rise FROM rises"),
)
def onset_strength(r: Roles):
    return ops.onset_rises(r.frames(), 38, 80).withColumn("rise", F.round("rise", 6))


@query(
    "a21_onset_envelope",
    with_roles(
        "rises frame_times",
        f"""WITH s AS (SELECT clip_id, frame, time_s, rise,
            lead(time_s) OVER w AS t1, lead(rise) OVER w AS v1
            FROM rises JOIN frame_times USING (clip_id, frame)
            WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
          g AS (SELECT clip_id, unnest(range(0, floor(max(time_s) * {FPS!r}::DOUBLE)::BIGINT + 1)) AS step
            FROM frame_times GROUP BY 1)
        SELECT g.clip_id, step::INT AS step, round(CASE WHEN t1 IS NULL THEN rise
          ELSE rise + (step / {FPS!r}::DOUBLE - time_s) / (t1 - time_s) * (v1 - rise) END, 6) AS value
        FROM g JOIN s ON s.clip_id = g.clip_id AND step / {FPS!r}::DOUBLE >= time_s
          AND (t1 IS NULL OR step / {FPS!r}::DOUBLE < t1)""",
    ),
)
def onset_envelope(r: Roles):
    rises = ops.onset_rises(r.frames(), 38, 80).withColumnRenamed("rise", "value")
    timed = rises.join(frame_times(r), ["clip_id", "frame"])
    return ops.resample(timed, FPS).withColumn("value", F.round("value", 6))


def _peak_sql(table: str, column: str, threshold: float, k: int) -> str:
    ahead = ", ".join(
        f"lag({column}, {i}) OVER w AS b{i}, lead({column}, {i}) OVER w AS a{i}" for i in range(1, k + 1)
    )
    chain = " AND ".join(
        f"{'b' + str(i - 1) if i > 1 else column} >= b{i} AND {'a' + str(i - 1) if i > 1 else column} >= a{i}"
        for i in range(1, k + 1)
    )
    return f"""SELECT clip_id, pitch, frame, CASE WHEN {column} = least(b1, a1) THEN 0
          ELSE (a1 - b1) / ({column} - least(b1, a1)) / 2 END AS shift
        FROM (SELECT *, {ahead} FROM {table} WINDOW w AS (PARTITION BY clip_id, pitch ORDER BY frame))
        WHERE {column} > {threshold} AND {chain}"""


add_role("onset_peaks", "curves", _peak_sql("curves", "value", 0.3, 2))
add_role("offset_peaks", "curves", _peak_sql("curves", "offset_value", 0.3, 4))


@query(
    "w13_onset_peaks",
    with_roles("onset_peaks", "SELECT clip_id, pitch, frame, round(shift, 9) AS shift FROM onset_peaks"),
)
def onset_peaks(r: Roles):
    return ops.peaks(curve(r), 0.3, 2).withColumn("shift", F.round("shift", 9))


@query(
    "w13_offset_peaks",
    with_roles("offset_peaks", "SELECT clip_id, pitch, frame, round(shift, 9) AS shift FROM offset_peaks"),
)
def offset_peaks(r: Roles):
    return ops.peaks(curve(r, 7), 0.3, 4).withColumn("shift", F.round("shift", 9))


@query(
    "w14_decoded_notes",
    with_roles(
        "onset_peaks offset_peaks curves",
        """WITH n AS (SELECT clip_id, max(frame) + 1 AS n FROM curves GROUP BY 1),
          f AS (SELECT o.*, n,
            coalesce((SELECT min(frame) FROM onset_peaks x WHERE x.clip_id = o.clip_id
              AND x.pitch = o.pitch AND x.frame > o.frame), n) AS following,
            coalesce((SELECT min(frame) FROM offset_peaks x WHERE x.clip_id = o.clip_id
              AND x.pitch = o.pitch AND x.frame > o.frame), n) AS ended,
            coalesce((SELECT min(frame) FROM curves x WHERE x.clip_id = o.clip_id
              AND x.pitch = o.pitch AND x.frame > o.frame AND frame_value <= 0.2), n) AS gone,
            least(o.frame + 600, n - 1) AS lim
            FROM onset_peaks o JOIN n USING (clip_id) WHERE pitch BETWEEN 38 AND 80),
          e AS (SELECT *, following <= least(gone, lim) AS repicked,
            CASE WHEN following <= least(gone, lim) THEN following - 1
              WHEN gone <= lim THEN CASE WHEN ended <= gone AND ended - frame > gone - ended
                THEN ended ELSE gone END ELSE lim END AS end_frame FROM f)
        SELECT e.clip_id, e.pitch, e.frame, end_frame,
          round((e.frame + e.shift) / 100.0::DOUBLE, 9) AS start_s,
          round((end_frame + CASE WHEN repicked THEN 0 ELSE coalesce(p.shift, 0) END)
            / 100.0::DOUBLE, 9) AS end_s
        FROM e LEFT JOIN offset_peaks p ON p.clip_id = e.clip_id AND p.pitch = e.pitch
          AND p.frame = end_frame""",
    ),
)
def decoded_notes(r: Roles):
    notes = ops.decode_notes(curve(r), curve(r, 7), curve(r, 3), 38, 80)
    return notes.withColumn("start_s", F.round("start_s", 9)).withColumn("end_s", F.round("end_s", 9))


@query(
    "w28_window_plan",
    """WITH s AS (SELECT doc_id, n_chars, CASE WHEN n_chars > 1000
           THEN range(0, n_chars - 1000, 900) || [n_chars - 1000] ELSE [0] END AS starts FROM documents)
       SELECT clip_id, (i - 1)::INT AS "window", starts[i] AS start,
         CASE WHEN i = 1 THEN 0 ELSE starts[i] + 50 END AS keep_from,
         CASE WHEN i = len(starts) THEN n_chars ELSE starts[i + 1] + 50 END AS keep_to
       FROM (SELECT doc_id AS clip_id, n_chars, starts, unnest(range(1, len(starts) + 1)) AS i FROM s)""",
)
def window_plan(r: Roles):
    """Windows over clips as long as the documents are, a frame per character."""
    lengths = r.table("documents").select(
        F.col("doc_id").alias("clip_id"), F.col("n_chars").alias("n_frames")
    )
    return ops.window_plan(lengths)


@query(
    "w28_stitched_frames",
    with_roles("frames", "SELECT clip_id, frame, pitch, value FROM frames"),
)
def stitched_frames(r: Roles):
    """Frames repeated in overlapping windows come back exactly once."""
    f = r.frames()
    lengths = f.groupBy("clip_id").agg((F.max("frame") + 1).alias("n_frames"))
    plan = ops.window_plan(lengths, chunk=40, border=5)
    overlapping = f.join(plan, "clip_id").where(
        (F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("start") + 40)
    )
    rows = overlapping.select("clip_id", "window", "frame", "pitch", "value")
    return ops.stitch(rows, plan).drop("window")


add_role(
    "midi",
    "messages",
    """SELECT user_id AS clip_id, event_id AS seq, k + 1 AS delta, k % 6 AS channel,
         40 + event_id % 5 AS pitch, (k * 3) % 90 AS velocity,
         event_type IN ('click', 'view', 'purchase') AS is_on FROM messages""",
)


@query(
    "w27_paired_notes",
    with_roles(
        "midi",
        """WITH t AS (SELECT *, (sum(delta) OVER (PARTITION BY clip_id ORDER BY seq))::BIGINT AS now,
            is_on AND velocity > 0 AS starts FROM midi),
          p AS (SELECT *, lag(starts) OVER w AS open, lag(now) OVER w AS opened FROM t
            WINDOW w AS (PARTITION BY clip_id, channel, pitch ORDER BY seq))
        SELECT clip_id, seq, channel, pitch, opened AS onset, now AS "offset", channel + 1 AS string
        FROM p WHERE NOT starts AND open""",
    ),
)
def paired_notes(r: Roles):
    k = F.col("k")
    events = r.messages().select(
        F.col("user_id").alias("clip_id"),
        F.col("event_id").alias("seq"),
        (k + 1).alias("delta"),
        (k % 6).alias("channel"),
        (F.lit(40) + F.col("event_id") % 5).alias("pitch"),
        (k * 3 % 90).alias("velocity"),
        F.col("event_type").isin("click", "view", "purchase").alias("is_on"),
    )
    return ops.pair_notes(events)


@query(
    "a37_waveform_bars",
    with_roles(
        "frames",
        """WITH l AS (SELECT clip_id, frame AS position, max(value) AS level FROM frames GROUP BY 1, 2),
          n AS (SELECT clip_id, count(*) AS n FROM l GROUP BY 1)
        SELECT n.clip_id, slot, max(level) AS level FROM n, range(0, 32) t(slot), l
        WHERE l.clip_id = n.clip_id AND position >= slot * n // 32 AND position < (slot + 1) * n // 32
        GROUP BY 1, 2""",
    ),
)
def waveform_bars(r: Roles):
    per_frame = r.frames().groupBy("clip_id", F.col("frame").alias("position"))
    return ops.waveform(per_frame.agg(F.max("value").alias("level")), 32)


@query(
    "a35_latencies",
    with_roles(
        "messages",
        """WITH e AS (SELECT user_id AS clip_id, event_id AS note_idx, unnest(range(-6, 7)) AS lag, k
            FROM messages),
          b AS (SELECT clip_id, note_idx, arg_max(lag, ((k * 31 + (lag + 6) * 17) % 23, -lag)) AS lag
            FROM e GROUP BY 1, 2)
        SELECT clip_id, round(-quantile_cont(lag, 0.5) * 0.005::DOUBLE, 9) AS latency_s FROM b GROUP BY 1""",
    ),
)
def latencies(r: Roles):
    m = r.messages().select(
        F.col("user_id").alias("clip_id"),
        F.col("event_id").alias("note_idx"),
        "k",
        F.explode(F.sequence(F.lit(-6), F.lit(6))).alias("lag"),
    )
    energy = (F.col("k") * 31 + (F.col("lag") + 6) * 17) % 23
    found = ops.latency(m.withColumn("energy", energy), 0.005)
    return found.withColumn("latency_s", F.round(F.col("latency_s") + F.lit(0.0), 9))


# --- levels ---

add_role(
    "blocks",
    "notes",
    """WITH p AS (SELECT clip_id, onset // 1000 AS block, sum(velocity * velocity)::BIGINT AS e
           FROM notes GROUP BY 1, 2),
         s AS (SELECT clip_id, unnest(range(0, max(block) + 1)) AS block FROM p GROUP BY 1)
       SELECT clip_id, block, coalesce(e, 0) / 100000000.0::DOUBLE AS power
       FROM s LEFT JOIN p USING (clip_id, block)""",
)
add_role(
    "loudness",
    "blocks",
    """WITH g AS (SELECT clip_id, block, avg(power) OVER w AS power FROM blocks
           WINDOW w AS (PARTITION BY clip_id ORDER BY block ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)
           QUALIFY count(*) OVER w = 4),
         l AS (SELECT *, -0.691::DOUBLE + 10 * log10(power) AS lufs FROM g WHERE power > 1e-12),
         a AS (SELECT * FROM l WHERE lufs > -70),
         t AS (SELECT clip_id, -0.691::DOUBLE + 10 * log10(avg(power)) - 10 AS gate FROM a GROUP BY 1)
       SELECT a.clip_id, -0.691::DOUBLE + 10 * log10(avg(power)) AS loudness
       FROM a JOIN t USING (clip_id) WHERE lufs > gate GROUP BY 1""",
)


def blocks(r: Roles):
    """Energy of every 100 ms of each clip, silent stretches included."""
    power = (
        r.notes()
        .groupBy("clip_id", F.expr("onset div 1000").alias("block"))
        .agg(F.sum(F.col("velocity") * F.col("velocity")).alias("energy"))
    )
    last = power.groupBy("clip_id").agg(F.max("block").alias("last"))
    spine = last.select("clip_id", F.explode(F.expr("sequence(0L, last)")).alias("block"))
    return spine.join(power, ["clip_id", "block"], "left").select(
        "clip_id", "block", (F.coalesce("energy", F.lit(0)) / 100_000_000.0).alias("power")
    )


@query(
    "w7_gating_blocks",
    with_roles(
        "blocks",
        """SELECT clip_id, block, round(avg(power) OVER w, 10) AS power FROM blocks
        WINDOW w AS (PARTITION BY clip_id ORDER BY block ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)
        QUALIFY count(*) OVER w = 4""",
    ),
)
def gating_blocks(r: Roles):
    return levels.gating_blocks(blocks(r)).withColumn("power", F.round("power", 10))


@query(
    "f18_block_lufs",
    with_roles(
        "blocks",
        """SELECT clip_id, block, round(-0.691::DOUBLE + 10 * log10(power), 6) AS lufs FROM blocks
        WHERE power > 0""",
    ),
)
def block_lufs(r: Roles):
    loud = blocks(r).where(F.col("power") > 0)
    return loud.select("clip_id", "block", F.round(levels.lufs(F.col("power")), 6).alias("lufs"))


@query(
    "a32_integrated_loudness",
    with_roles("loudness", "SELECT clip_id, round(loudness, 6) AS loudness FROM loudness"),
)
def integrated_loudness(r: Roles):
    return levels.integrated_loudness(blocks(r)).withColumn("loudness", F.round("loudness", 6))


@query(
    "a33_sound_bounds",
    with_roles(
        "blocks",
        """WITH d AS (SELECT clip_id, block, 10 * log10(power + 1e-12::DOUBLE) AS db,
            count(*) OVER (PARTITION BY clip_id) * 1024 + clip_id % 1024 AS samples FROM blocks),
          m AS (SELECT clip_id, max(db) AS loudest FROM d GROUP BY 1)
        SELECT d.clip_id, any_value(loudest) < -60 AS silent,
          greatest(0, min(block) * 1024 - 4410) AS start,
          least(any_value(samples), (max(block) + 1) * 1024 + 4410) AS "end"
        FROM d JOIN m USING (clip_id) WHERE db > greatest(-60, loudest - 40) GROUP BY 1""",
    ),
)
def sound_bounds(r: Roles):
    b = blocks(r)
    sizes = b.groupBy("clip_id").agg(
        ((F.max("block") + 1) * 1024 + F.col("clip_id") % 1024).alias("samples")
    )
    return levels.sound_bounds(b, sizes)


@query(
    "a34_gains",
    with_roles(
        "loudness notes",
        """WITH p AS (SELECT clip_id, max(velocity) / 400.0::DOUBLE AS peak FROM notes GROUP BY 1),
          w AS (SELECT clip_id, peak, pow(10.0::DOUBLE, (-20 - loudness) / 20) AS wanted
            FROM loudness JOIN p USING (clip_id))
        SELECT clip_id, round(CASE WHEN peak * wanted > 0.99 THEN 0.99::DOUBLE / peak ELSE wanted END, 6)
          AS gain FROM w""",
    ),
)
def gains(r: Roles):
    peaks = r.notes().groupBy("clip_id").agg((F.max("velocity") / 400.0).alias("peak"))
    found = levels.gains(levels.integrated_loudness(blocks(r)), peaks)
    return found.withColumn("gain", F.round("gain", 6))
