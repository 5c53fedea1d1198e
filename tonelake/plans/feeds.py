"""Landed records and stored files: account feed, annotations, scores, logs, manifests, backups.

The supplied tables hold no such files, so each query first writes the table's rows as the JSON
text a landing zone would hold and then reads that text back with the source's own reader.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tonelake.plans.billing import subscriptions
from tonelake.plans.library import plan_requests, result_cache, runs, version_files
from tonelake.plans.overview import tokens
from tonelake.plans.registry import query
from tonelake.plans.role_sql import JOBS_AS_OF, add_role, with_roles
from tonelake.sources import artifacts, records
from tonelake.sources.roles import JOBS_AS_OF as AS_OF
from tonelake.sources.roles import Roles, ts


def account_pages(r: Roles):
    a = r.accounts()
    uid = F.col("user_id").cast("string")
    primary = F.concat(F.lit("em_"), uid)
    body = F.struct(
        F.concat(F.lit("user_"), uid).alias("id"),
        F.when(F.col("user_id") % 9 > 0, primary).alias("primary_email_address_id"),
        F.expr("unix_millis(joined)").alias("created_at"),
        F.when(F.col("user_id") % 4 > 0, F.expr("unix_millis(last_active)"))
        .when(F.col("user_id") % 8 == 0, F.lit(0))
        .alias("last_active_at"),
        F.when(F.col("user_id") % 3 > 0, F.expr("unix_millis(joined)")).alias("last_sign_in_at"),
        F.array(
            F.struct(F.lit("em_old").alias("id"), F.lit("old@mail.test").alias("email_address")),
            F.struct(primary.alias("id"), F.col("email").alias("email_address")),
        ).alias("email_addresses"),
        F.array(
            F.struct(
                F.when(F.col("method") == "google", "oauth_google")
                .otherwise("oauth_apple")
                .alias("provider")
            )
        ).alias("external_accounts"),
    )
    return a.select(F.to_json(body).alias("body"))


@query(
    "s2_account_feed",
    with_roles(
        "accounts",
        """SELECT 'user_' || user_id AS user_id, CASE WHEN user_id % 9 > 0 THEN email END AS email,
          method, joined, coalesce(CASE WHEN user_id % 4 > 0 THEN last_active END,
            CASE WHEN user_id % 3 > 0 THEN joined END) AS last_active FROM accounts""",
    ),
)
def account_feed(r: Roles):
    return records.accounts(account_pages(r))


@query(
    "s14_accounts_without_feed",
    with_roles(
        "accounts users",
        """SELECT user_id, joined, 'unknown' AS method FROM accounts JOIN users USING (user_id)""",
    ),
)
def accounts_without_feed(r: Roles):
    created = r.accounts().select("user_id", F.col("joined").alias("created_at"))
    users = r.users().join(created, "user_id")
    return records.accounts_or_users(None, users).select("user_id", "joined", "method")




@query(
    "s1_table_scans",
    with_roles(
        "accounts users jobs runs versions messages tokens subscriptions plan_requests result_cache",
        """SELECT 'accounts' AS role, count(*) AS records FROM accounts UNION ALL
        SELECT 'users', count(*) FROM users UNION ALL SELECT 'jobs', count(*) FROM jobs UNION ALL
        SELECT 'stage_runs', count(*) FROM runs UNION ALL
        SELECT 'score_versions', count(*) FROM versions UNION ALL
        SELECT 'events', count(*) FROM messages UNION ALL
        SELECT 'push_tokens', count(*) FROM tokens UNION ALL
        SELECT 'subscriptions', count(*) FROM subscriptions UNION ALL
        SELECT 'admin_actions', count(*) FROM plan_requests UNION ALL
        SELECT 'result_cache', count(*) FROM result_cache""",
    ),
)
def table_scans(r: Roles):
    roles = {
        "accounts": r.accounts(),
        "users": r.users(),
        "jobs": r.jobs(),
        "stage_runs": runs(r),
        "score_versions": r.versions(),
        "events": r.messages(),
        "push_tokens": tokens(r),
        "subscriptions": subscriptions(r),
        "admin_actions": plan_requests(r),
        "result_cache": result_cache(r),
    }
    out = None
    for name, df in roles.items():
        row = df.agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("role"), "records")
        out = row if out is None else out.unionByName(row)
    return out


# --- annotations: one small document per event ---


def annotation_documents(r: Roles):
    k, value = F.col("k"), F.col("value")
    kinds = F.array(*map(F.lit, ["note_midi", "beat_position", "chord", "tempo"]))

    def observation(step):
        return F.struct(
            (value / 10 + step * 0.5).alias("time"),
            (F.lit(0.25) + (k % 8) * 0.25).alias("duration"),
            (F.lit(40) + (k + step) % 45).cast("string").alias("value"),
        )

    data = F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), observation)
    annotation = F.struct(
        F.element_at(kinds, (k % 4 + 1).cast("int")).alias("namespace"),
        F.struct(F.when(k % 7 > 0, (k % 6).cast("string")).otherwise("").alias("data_source")).alias(
            "annotation_metadata"
        ),
        data.alias("data"),
    )
    return r.messages().select(
        "event_id",
        ((k % 5) * 0.5).alias("excerpt_start"),
        F.to_json(F.struct(F.array(annotation).alias("annotations"))).alias("body"),
    )


add_role(
    "observations",
    "messages",
    """SELECT event_id, k, i, (['note_midi','beat_position','chord','tempo'])[k % 4 + 1] AS namespace,
         CASE WHEN k % 7 > 0 THEN (k % 6)::VARCHAR ELSE '' END AS data_source,
         value / 10 + i * 0.5::DOUBLE - (k % 5) * 0.5::DOUBLE AS t_on,
         value / 10 + i * 0.5::DOUBLE + (0.25::DOUBLE + (k % 8) * 0.25::DOUBLE)
           - (k % 5) * 0.5::DOUBLE AS t_off,
         40 + (k + i) % 45 AS v
       FROM (SELECT *, unnest(range(0, k % 3 + 1)) AS i FROM messages)""",
)


@query(
    "s6_annotation_rows",
    with_roles(
        "observations",
        """SELECT event_id, namespace, i::INT AS observation, round_even(greatest(t_on, 0), 4)
            AS onset_s, round_even(least(t_off, 20.0::DOUBLE), 4) AS offset_s FROM observations
        WHERE (namespace IN ('note_midi', 'beat_position') AND t_on >= 0 AND t_on < 20)
          OR (namespace = 'chord' AND data_source <> '' AND t_off > 0 AND t_on < 20)""",
    ),
)
def annotation_rows(r: Roles):
    rows = records.annotations(annotation_documents(r), F.col("excerpt_start"))
    return rows.select("event_id", "namespace", "observation", "onset_s", "offset_s")


@query(
    "s6_annotated_notes",
    with_roles(
        "observations",
        """SELECT event_id, i::INT AS observation, v::INT AS pitch,
          (6 - data_source::INT)::INT AS string,
          (v - ([40, 45, 50, 55, 59, 64])[data_source::INT + 1])::INT AS fret FROM observations
        WHERE namespace = 'note_midi' AND t_on >= 0 AND t_on < 20 AND data_source <> ''""",
    ),
)
def annotated_notes(r: Roles):
    rows = records.annotations(annotation_documents(r), F.col("excerpt_start"))
    notes = records.annotated_notes(rows.where(F.col("data_source") != ""))
    return notes.select("event_id", "observation", "pitch", "string", "fret")


@query(
    "s6_first_tempo",
    with_roles(
        "messages",
        """SELECT event_id, CASE WHEN k % 4 = 3 THEN (40 + k % 45)::DOUBLE ELSE -1 END AS tempo_bpm
        FROM messages""",
    ),
)
def first_tempo(r: Roles):
    found = records.first_tempo(annotation_documents(r), "event_id")
    return found.select("event_id", F.coalesce("tempo_bpm", F.lit(-1.0)).alias("tempo_bpm"))


@query(
    "s5_truth_corpus_suites",
    with_roles(
        "messages",
        """SELECT suite, instrument, count(*) AS clips, sum(k % 3 + 1)::BIGINT AS notes FROM (
          SELECT (['excerpts', 'techniques', 'keys'])[k % 3 + 1] AS suite,
            (['guitar', 'guitar', 'piano'])[k % 3 + 1] AS instrument, k FROM messages)
        GROUP BY 1, 2""",
    ),
)
def truth_corpus_suites(r: Roles):
    """Truth documents as text next to their path, parsed with the corpus schema."""
    suites = F.array(*map(F.lit, ["excerpts", "techniques", "keys"]))
    kinds = F.create_map(
        *[F.lit(x) for x in ("excerpts", "guitar", "techniques", "guitar", "keys", "piano")]
    )
    note = F.struct(
        F.lit(0.5).alias("onset_s"), F.lit(1.0).alias("offset_s"), F.lit(60).alias("pitch")
    )
    document = F.struct(
        F.col("event_id").cast("string").alias("track"),
        F.array_repeat(note, (F.col("k") % 3 + 1).cast("int")).alias("notes"),
    )
    path = F.concat(
        F.lit("/truth/"),
        F.element_at(suites, (F.col("k") % 3 + 1).cast("int")),
        F.lit("/"),
        F.col("event_id").cast("string"),
        F.lit(".truth.json"),
    )
    docs = r.messages().select(path.alias("path"), F.to_json(document).alias("body"))
    parsed = docs.select(
        F.regexp_extract("path", r"/([^/]+)/[^/]+\.truth\.json$", 1).alias("suite"),
        F.from_json("body", records.TRUTH).alias("t"),
    )
    return (
        parsed.withColumn("instrument", kinds[F.col("suite")])
        .groupBy("suite", "instrument")
        .agg(
            F.count(F.lit(1)).alias("clips"),
            F.sum(F.size("t.notes")).cast("bigint").alias("notes"),
        )
    )


@query(
    "s7_score_documents",
    with_roles(
        "notes",
        """SELECT note_idx, pitch::INT AS pitch, (note_idx % 97) * 3 AS onset12, 8 AS duration12,
          120.5::DOUBLE AS tempo_bpm FROM notes""",
    ),
)
def score_documents(r: Roles):
    note = F.struct(
        "pitch",
        "velocity",
        F.concat((F.col("note_idx") % 97).cast("string"), F.lit("/4")).alias("onset_beats"),
        F.lit("2/3").alias("duration_beats"),
        (F.col("onset") / 10_000).alias("onset_s"),
        (F.col("offset") / 10_000).alias("offset_s"),
    )
    score = F.struct(F.lit(120.5).alias("tempo_bpm"), F.array(note).alias("notes"))
    docs = r.notes().select("note_idx", F.to_json(score).alias("body"))
    return records.score_notes(docs).select(
        "note_idx", "pitch", "onset12", F.col("duration12").cast("int").alias("duration12"), "tempo_bpm"
    )


@query(
    "s7_tab_documents",
    with_roles(
        "notes",
        """SELECT note_idx, ((note_idx % 97) * 3)::BIGINT AS onset12, pitch::INT AS pitch,
          (note_idx % 7)::INT AS string, (note_idx % 13)::INT AS fret, CASE WHEN note_idx % 7 > 0
            THEN ([64, 59, 55, 50, 45, 40])[note_idx % 7] + 2 + note_idx % 13 END::INT AS sounds FROM notes""",
    ),
)
def tab_documents(r: Roles):
    i = F.col("note_idx")
    note = F.struct(
        F.concat((i % 97).cast("string"), F.lit("/4")).alias("onset_beats"),
        "pitch",
        (i % 7).alias("string"),
        (i % 13).alias("fret"),
    )
    tuning = F.array(*[F.lit(p) for p in (40, 45, 50, 55, 59, 64)])
    tab = F.struct(tuning.alias("tuning"), F.lit(2).alias("capo"), F.array(note).alias("notes"))
    return records.tab_notes(r.notes().select("note_idx", F.to_json(tab).alias("body")))


@query(
    "s7_note_documents",
    with_roles(
        "notes",
        """SELECT clip_id, note_idx AS doc, n::INT AS note, onset / 10000.0::DOUBLE AS onset_s,
          "offset" / 10000.0::DOUBLE AS offset_s, (pitch + n)::INT AS pitch, velocity::INT AS velocity,
          0.5::DOUBLE AS amplitude FROM notes, range(0, 3) t(n) WHERE n < note_idx % 4""",
    ),
)
def note_documents(r: Roles):
    """Documents of none to three notes each."""

    def note(n):
        return F.struct(
            (F.col("onset") / 10_000).alias("onset_s"),
            (F.col("offset") / 10_000).alias("offset_s"),
            (F.col("pitch") + n).alias("pitch"),
            "velocity",
            F.lit(0.5).alias("amplitude"),
        )

    all_ = F.array(*[note(n) for n in range(3)])
    body = F.struct(F.slice(all_, 1, (F.col("note_idx") % 4).cast("int")).alias("notes"))
    return records.heard_notes(r.notes().select("clip_id", F.col("note_idx").alias("doc"), F.to_json(body).alias("body")))


# --- logs ---


@query(
    "s10_structured_logs",
    with_roles(
        "attempts",
        """SELECT coalesce(CASE WHEN message_id % 50 > 0 THEN stage END, '?') AS stage,
          count(*) AS lines, count(*) FILTER (message_id % 50 = 0) AS unreadable,
          coalesce(sum(duration_s) FILTER (message_id % 50 > 0), 0) AS seconds
        FROM attempts GROUP BY 1""",
    ),
)
def structured_logs(r: Roles):
    line = F.to_json(
        F.struct(
            F.col("finished_at").alias("ts"),
            F.lit("INFO").alias("level"),
            F.lit("worker").alias("service"),
            F.concat(F.lit("stage "), F.col("status")).alias("message"),
            F.col("job_id").cast("string").alias("job_id"),
            "stage",
            "duration_s",
        )
    )
    broken = F.concat(F.lit("{not json "), F.col("stage"))
    lines = r.stage_attempts().select(
        F.when(F.col("message_id") % 50 == 0, broken).otherwise(line).alias("line")
    )
    parsed = records.logs(lines)
    return parsed.groupBy(F.coalesce("stage", F.lit("?")).alias("stage")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count("_corrupt_record").alias("unreadable"),
        F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("seconds"),
    )


# --- stored files ---


def listing(r: Roles):
    key = F.concat(F.lit("users/"), F.col("job_id") % 20, F.lit("/jobs/"), "job_id", F.lit("/"), "file")
    return version_files(r).select(key.alias("key"), (F.col("job_id") % 1000 + 1).alias("size"))


@query(
    "s8_artifact_inventory",
    with_roles(
        "version_files",
        """SELECT 'users/' || (job_id % 20) || '/' AS prefix, count(*) AS objects,
          sum(job_id % 1000 + 1)::BIGINT AS bytes FROM version_files GROUP BY 1""",
    ),
)
def artifact_inventory(r: Roles):
    return artifacts.inventory(listing(r), 2)


@query(
    "s8_objects_below_prefix",
    with_roles(
        "version_files",
        """SELECT 'users/1/jobs/' || job_id || '/' || file AS key FROM version_files
        WHERE job_id % 20 = 1""",
    ),
)
def objects_below_prefix(r: Roles):
    return artifacts.below_prefix(listing(r), "users/1/").select("key")


@query(
    "s9_intact_manifests",
    """WITH m AS (SELECT doc_id % 200 AS unit, lang AS stage, bool_and(doc_id % 37 <> 0) AS whole
         FROM documents GROUP BY 1, 2)
       SELECT unit, stage FROM m WHERE whole AND unit % 11 <> 0""",
)
def intact_manifests(r: Roles):
    docs = r.table("documents")
    unit = F.col("doc_id") % 200
    path = F.col("doc_id").cast("string")
    files = docs.select(path.alias("path"), F.sha2("text", 256).alias("sha256"))
    recorded = F.when(F.col("doc_id") % 37 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(
        F.sha2("text", 256)
    )
    manifests = docs.select(
        unit.alias("unit"),
        F.col("lang").alias("stage"),
        F.concat(F.lit("key-"), unit.cast("string")).alias("cache_key"),
        path.alias("path"),
        recorded.alias("sha256"),
    )
    expected = F.when(F.col("unit") % 11 == 0, "other").otherwise(F.col("cache_key"))
    keys = manifests.select("unit", "stage", expected.alias("cache_key")).distinct()
    return artifacts.intact_outputs(manifests, files, keys).select("unit", "stage")


_BACKUPS = """SELECT strftime(o_orderdate, 'backups/%Y-%m-%d') || '-' || o_orderkey || '.dump' AS key,
    o_orderdate AS modified_at FROM orders"""
add_role("backups", "", _BACKUPS)


def backups(r: Roles):
    o = r.table("orders")
    key = F.concat(
        F.date_format("o_orderdate", "'backups/'yyyy-MM-dd'-'"),
        F.col("o_orderkey").cast("string"),
        F.lit(".dump"),
    )
    return o.select(key.alias("key"), F.col("o_orderdate").alias("modified_at"))


@query(
    "s13_expired_backups",
    with_roles(
        "backups",
        f"""SELECT key FROM backups WHERE modified_at < {JOBS_AS_OF} - INTERVAL 14 DAY
          AND key <> (SELECT max(key) FROM backups)""",
    ),
)
def expired_backups(r: Roles):
    return artifacts.expired_backups(backups(r), ts(AS_OF)).select("key")


@query(
    "w26_newest_backup",
    with_roles("backups", "SELECT max(key) AS key FROM backups"),
)
def newest_backup(r: Roles):
    return backups(r).agg(F.max("key").alias("key"))


# --- sampling for tuning sets ---

add_role(
    "tracks",
    "",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'comp' ELSE 'solo' END AS mode,
         md5('2026/' || doc_id) AS place FROM documents
       WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)


def candidate_tracks(r: Roles):
    """Every track that is not held out, with a seeded shuffle key."""
    held_out = r.table("labels").where(F.col("quality") == 1).select("doc_id")
    mode = F.when(F.col("doc_id") % 3 == 0, "comp").otherwise("solo")
    return (
        r.table("documents")
        .select(
            "doc_id",
            mode.alias("mode"),
            F.md5(F.concat(F.lit("2026/"), F.col("doc_id").cast("string"))).alias("place"),
        )
        .join(held_out, "doc_id", "left_anti")
    )


@query("x5_held_out_exclusion", with_roles("tracks", "SELECT doc_id, mode FROM tracks"))
def held_out_exclusion(r: Roles):
    return candidate_tracks(r).select("doc_id", "mode")


@query(
    "t9_balanced_sample",
    with_roles(
        "tracks",
        """SELECT doc_id, mode FROM tracks
        QUALIFY row_number() OVER (PARTITION BY mode ORDER BY place, doc_id) <= 12""",
    ),
)
def balanced_sample(r: Roles):
    order = Window.partitionBy("mode").orderBy("place", "doc_id")
    ranked = candidate_tracks(r).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= 12).select("doc_id", "mode")
