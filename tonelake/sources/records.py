"""Flattening of landed JSON records: accounts, subscribers, webhooks, logs, annotations, scores.

Every reader takes text already in a DataFrame (one document per row) and an explicit schema, so
nothing is inferred from data. `read_json_pages` reads such documents from files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions import text
from tonelake.functions.constants import STANDARD_TUNING

ACCOUNT = """id string, primary_email_address_id string, created_at bigint, last_active_at bigint,
    last_sign_in_at bigint, email_addresses array<struct<id:string,email_address:string>>,
    external_accounts array<struct<provider:string>>"""
SUBSCRIPTION = """struct<is_sandbox:boolean,store:string,period_type:string,purchase_date:string,
    original_purchase_date:string,expires_date:string,billing_issues_detected_at:string,
    grace_period_expires_date:string,unsubscribe_detected_at:string,refunded_at:string,
    store_transaction_id:string>"""
SUBSCRIBER = f"""subscriber struct<subscriptions:map<string,{SUBSCRIPTION}>,
    entitlements:map<string,struct<product_identifier:string>>>"""
WEBHOOK = """event struct<id:string,type:string,environment:string,app_user_id:string,
    original_app_user_id:string,transferred_from:array<string>,transferred_to:array<string>,
    store:string,product_id:string,event_timestamp_ms:bigint>"""
LOG = """ts timestamp, level string, service string, message string, job_id string, stage string,
    attempt int, duration_s double, _corrupt_record string"""
OBSERVATION = "struct<time:double,duration:double,value:string>"
ANNOTATED = f"""annotations array<struct<namespace:string,
    annotation_metadata:struct<data_source:string>,data:array<{OBSERVATION}>>>"""
SCORE = """tempo_bpm double, pickup_beats int, notes array<struct<pitch:int,velocity:int,
    onset_beats:string,duration_beats:string,onset_s:double,offset_s:double>>"""
TAB = """tuning array<int>, capo int,
    notes array<struct<onset_beats:string,pitch:int,string:int,fret:int>>"""
HEARD = "notes array<struct<onset_s:double,offset_s:double,pitch:int,velocity:int,amplitude:double>>"
TRUTH = """track string, source string, license string, start_s double, duration_s double,
    midi_latency_s double, tempo_bpm double,
    notes array<struct<onset_s:double,offset_s:double,pitch:int,string:int,fret:int>>,
    beats_s array<double>, downbeats_s array<double>,
    chords array<struct<onset_s:double,offset_s:double,label:string>>"""
EXCERPT_S = 20.0


def read_json_pages(spark: SparkSession, path: str) -> DataFrame:
    """One document per file."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")


def accounts(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row per account: primary address, sign-in method, last activity."""
    a = pages.select(F.from_json(body, ACCOUNT).alias("a")).select("a.*")
    primary = F.filter(
        F.coalesce("email_addresses", F.array()),
        lambda e: e["id"] == F.col("primary_email_address_id"),
    )
    google = F.exists(
        F.coalesce("external_accounts", F.array()), lambda x: x["provider"].contains("google")
    )

    def recorded(name: str) -> Column:
        return F.when(F.col(name) != 0, F.col(name))

    return a.select(
        F.col("id").alias("user_id"),
        F.try_element_at(primary, F.lit(1))["email_address"].alias("email"),
        F.when(google, "google").otherwise("email").alias("method"),
        text.from_millis(F.col("created_at")).alias("joined"),
        text.from_millis(F.coalesce(recorded("last_active_at"), recorded("last_sign_in_at"))).alias(
            "last_active"
        ),
    )


def accounts_or_users(feed: DataFrame | None, users: DataFrame) -> DataFrame:
    """The account feed when one is configured, else the users table with nothing else known.

    A configured feed that cannot be read raises from Spark; it never falls back silently.
    """
    if feed is not None:
        return feed
    return users.select(
        "user_id",
        F.lit(None).cast("string").alias("email"),
        F.lit("unknown").alias("method"),
        F.col("created_at").alias("joined"),
        F.lit(None).cast("timestamp").alias("last_active"),
    )


def subscribers(docs: DataFrame, body: str = "body") -> DataFrame:
    """One row per product of each subscriber, with the entitlement it unlocks."""
    d = docs.select("user_id", F.from_json(body, SUBSCRIBER)["subscriber"].alias("s"))
    rows = d.select(
        "user_id", "s.entitlements", F.explode("s.subscriptions").alias("product_id", "sub")
    )

    def base(product: Column) -> Column:
        return F.split(product, ":")[0]

    matching = F.filter(
        F.map_entries(F.coalesce("entitlements", F.create_map())),
        lambda e: base(e["value"]["product_identifier"]) == base(F.col("product_id")),
    )

    def when(name: str) -> Column:
        return F.try_to_timestamp(F.when(F.col(f"sub.{name}") != "", F.col(f"sub.{name}")))

    def cut(name: str, length: int, default: str) -> Column:
        value = F.when(F.col(f"sub.{name}") != "", F.col(f"sub.{name}"))
        return F.substring(F.coalesce(value, F.lit(default)), 1, length)

    transaction = F.when(F.col("sub.store_transaction_id") != "", F.col("sub.store_transaction_id"))
    return rows.select(
        "user_id",
        F.when(F.coalesce("sub.is_sandbox", F.lit(False)), "sandbox")
        .otherwise("production")
        .alias("environment"),
        cut("store", 32, "unknown").alias("store"),
        F.substring("product_id", 1, 128).alias("product_id"),
        F.try_element_at(matching, F.lit(1))["key"].alias("entitlement"),
        cut("period_type", 16, "normal").alias("period_type"),
        when("purchase_date").alias("purchased_at"),
        when("original_purchase_date").alias("original_purchased_at"),
        when("expires_date").alias("expires_at"),
        when("billing_issues_detected_at").alias("billing_issue_at"),
        when("grace_period_expires_date").alias("grace_period_expires_at"),
        when("unsubscribe_detected_at").alias("unsubscribed_at"),
        when("refunded_at").alias("refunded_at"),
        F.substring(transaction, 1, 128).alias("store_transaction_id"),
    )


def webhooks(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Typed columns of each store event next to its whole payload."""
    e = bodies.select(F.from_json(body, WEBHOOK)["event"].alias("e"), F.col(body).alias("payload"))
    ids = F.concat(
        F.array("e.app_user_id", "e.original_app_user_id"),
        F.coalesce("e.transferred_from", F.array()),
        F.coalesce("e.transferred_to", F.array()),
    )
    return e.select(
        F.col("e.id").alias("event_id"),
        F.col("e.type").alias("type"),
        F.coalesce("e.environment", F.lit("PRODUCTION")).alias("environment"),
        text.cut_or_null(F.col("e.store"), 32).alias("store"),
        text.cut_or_null(F.col("e.product_id"), 128).alias("product_id"),
        text.from_millis(F.col("e.event_timestamp_ms")).alias("event_at"),
        text.known_ids(ids).alias("user_ids"),
        "payload",
    )


def logs(lines: DataFrame, line: str = "line") -> DataFrame:
    """Structured log lines; one that is not JSON keeps its text in `_corrupt_record`."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return lines.select("*", F.from_json(line, LOG, options).alias("r")).select(
        *[c for c in lines.columns if c != line], "r.*"
    )


def annotations(docs: DataFrame, start: Column, body: str = "body") -> DataFrame:
    """Observations of the kept annotations inside the excerpt, in excerpt time.

    Kept are notes, beats and the chords that name their source. Onsets outside the excerpt go;
    chords only have to overlap it. Every other column of `docs` is carried along.
    """
    keys = [c for c in docs.columns if c != body]
    obs = (
        docs.select(*keys, start.alias("start_s"), F.from_json(body, ANNOTATED).alias("d"))
        .select(*keys, "start_s", F.explode("d.annotations").alias("a"))
        .select(
            *keys,
            "start_s",
            F.col("a.namespace").alias("namespace"),
            F.col("a.annotation_metadata.data_source").alias("data_source"),
            F.posexplode("a.data").alias("observation", "o"),
        )
    )
    on = F.col("o.time") - F.col("start_s")
    off = F.col("o.time") + F.coalesce("o.duration", F.lit(0.0)) - F.col("start_s")
    is_chord = (F.col("namespace") == "chord") & (F.coalesce("data_source", F.lit("")) != "")
    timed = F.col("namespace").isin("note_midi", "beat_position") & (on >= 0) & (on < EXCERPT_S)
    kept = timed | (is_chord & (off > 0) & (on < EXCERPT_S))
    return obs.where(kept).select(
        *keys,
        "namespace",
        "data_source",
        "observation",
        F.bround(F.greatest(on, F.lit(0.0)), 4).alias("onset_s"),
        F.bround(F.least(off, F.lit(EXCERPT_S)), 4).alias("offset_s"),
        F.col("o.value").alias("value"),
    )


def annotated_notes(observations: DataFrame) -> DataFrame:
    """Note observations with pitch, string (1 = highest) and fret."""
    strings = F.array(*map(F.lit, STANDARD_TUNING))
    index = F.col("data_source").cast("int")
    pitch = F.bround(F.col("value").cast("double")).cast("int")
    return (
        observations.where(F.col("namespace") == "note_midi")
        .withColumn("pitch", pitch)
        .withColumn("string", F.lit(6) - index)
        .withColumn("fret", F.col("pitch") - F.element_at(strings, index + 1))
    )


def first_tempo(docs: DataFrame, key: str, body: str = "body") -> DataFrame:
    """The first tempo annotation's first value."""
    found = F.filter(F.col("d.annotations"), lambda a: a["namespace"] == "tempo")
    return docs.select(key, F.from_json(body, ANNOTATED).alias("d")).select(
        key,
        F.try_element_at(F.try_element_at(found, F.lit(1))["data"], F.lit(1))["value"]
        .cast("double")
        .alias("tempo_bpm"),
    )


def twelfths(fraction: str) -> Column:
    """A fraction of a beat, written n/d or n, as whole twelfths."""
    parts = F.split(F.col(fraction), "/")
    denominator = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("1")).cast("bigint")
    return F.try_divide(parts[0].cast("bigint") * 12, denominator).cast("bigint")


def tab_notes(docs: DataFrame, body: str = "body") -> DataFrame:
    """Notes of tablature documents: onset12, pitch, string, fret, and sounds, what that place sounds.

    Strings count from the highest, the tuning from the lowest; a place that the tuning does not have sounds null.
    """
    keys = [c for c in docs.columns if c != body]
    rows = docs.select(*keys, F.from_json(body, TAB).alias("t"))
    rows = rows.select(*keys, "t.tuning", "t.capo", F.inline("t.notes"))
    strings = F.size("tuning")
    open_ = F.get("tuning", strings - F.col("string"))
    there = F.col("string").between(1, strings)
    return rows.withColumn("onset12", twelfths("onset_beats")).select(
        *keys, "onset12", "pitch", "string", "fret", F.when(there, open_ + F.col("capo") + F.col("fret")).alias("sounds")
    )


def heard_notes(docs: DataFrame, body: str = "body") -> DataFrame:
    """Notes of transcription documents, numbered from 0 within each."""
    keys = [c for c in docs.columns if c != body]
    return docs.select(*keys, F.from_json(body, HEARD).alias("h")).select(
        *keys, F.posexplode("h.notes").alias("note", "n")
    ).select(*keys, "note", "n.*")


def score_notes(docs: DataFrame, body: str = "body") -> DataFrame:
    """Notes of score documents, with beat fractions as whole twelfths of a beat."""
    keys = [c for c in docs.columns if c != body]
    return (
        docs.select(*keys, F.from_json(body, SCORE).alias("s"))
        .select(*keys, "s.tempo_bpm", F.inline("s.notes"))
        .withColumn("onset12", twelfths("onset_beats"))
        .withColumn("duration12", twelfths("duration_beats"))
        .drop("onset_beats", "duration_beats")
    )


def read_truth(spark: SparkSession, root: str, instruments: dict[str, str]) -> DataFrame:
    """Annotated clips below `root/<suite>/*.truth.json`, with suite and instrument."""
    path = F.col("_metadata.file_path")
    lookup = F.create_map(*[F.lit(x) for pair in instruments.items() for x in pair])
    suite = F.regexp_extract(path, r"/([^/]+)/[^/]+\.truth\.json$", 1)
    return (
        spark.read.schema(TRUTH)
        .option("multiLine", True)
        .json(f"{root}/*/*.truth.json")
        .select("*", suite.alias("suite"))
        .withColumn("instrument", lookup[F.col("suite")])
        .where(F.col("instrument").isNotNull())
    )
