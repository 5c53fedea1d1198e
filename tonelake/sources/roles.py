"""The supplied tables read in the roles of the service's own tables.

Each method is one role: a projection of one supplied table (or of another role) with the columns
the operators expect. Rules that stand in for missing columns are plain arithmetic on the row, so
the same rows can be written in SQL (`tonelake.plans.role_sql`).

Times inside a clip are whole ticks of 0.1 ms. Note times are published to four decimals of a
second, so ticks lose nothing and are safe as join and group keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampType

from tonelake.functions.constants import STAGES

TICKS_PER_SECOND = 10_000
# The corpus starts here; a month of events is squeezed into about 13 seconds per clip.
CORPUS_ORIGIN = "2024-01-01 00:00:00"
MICROS_PER_TICK = 20_000_000
JOBS_AS_OF = "2001-08-01 12:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


class Roles:
    """Role-mapped views of one directory of supplied Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def schema(self, name: str) -> StructType:
        """The table's schema with its timestamps as instants (they are written in UTC).

        Declaring them so, instead of casting after the scan, lets time filters reach Parquet.
        """
        stored = self.spark.read.parquet(self.path(name)).schema
        instant = TimestampType()
        return StructType(
            [
                StructField(f.name, instant if f.dataType.typeName() == "timestamp_ntz" else f.dataType)
                for f in stored.fields
            ]
        )

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema(name)).parquet(self.path(name))

    # --- product records ---

    def accounts(self) -> DataFrame:
        joined = F.expr("timestamp'1995-01-01 00:00:00' + make_dt_interval(c_custkey * 37 % 2404)")
        return self.table("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.concat(F.lower("c_name"), F.lit("@mail.test")).alias("email"),
            F.when(F.col("c_nationkey") % 2 == 0, "google").otherwise("email").alias("method"),
            joined.alias("joined"),
            F.when(
                F.col("c_acctbal") > 0,
                F.expr(
                    "timestamp'2001-08-01 12:00:00' - make_dt_interval(c_custkey * 13 % 45, 6)"
                ),
            ).alias("last_active"),
        )

    def users(self) -> DataFrame:
        """Everyone who started: a plan, and the terms they accepted."""
        c = self.table("customer").where(F.col("c_mktsegment") != "MACHINERY")
        return c.select(
            F.col("c_custkey").alias("user_id"),
            F.when(F.col("c_acctbal") > 1000, "2026-01").alias("terms_version"),
            F.when(F.col("c_mktsegment") == "BUILDING", "pro")
            .when(F.col("c_mktsegment") == "AUTOMOBILE", "unlimited")
            .otherwise("free")
            .alias("plan"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), "admin-1").alias(
                "plan_changed_by"
            ),
        )

    def jobs(self) -> DataFrame:
        status = (
            F.when(F.col("o_orderstatus") == "F", "failed")
            .when(F.col("o_orderstatus") == "O", "succeeded")
            .when(F.col("o_orderkey") % 5 == 0, "pending_upload")
            .otherwise("running")
        )
        instrument = F.when(F.col("o_orderkey") % 3 == 0, "piano").otherwise("guitar")
        failed = F.col("o_orderstatus") == "F"
        pending = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 5 == 0)
        wait = F.expr("make_dt_interval(0, 0, 0, o_orderkey % 97 + 0.25)")
        return self.table("orders").select(
            F.col("o_orderkey").alias("job_id"),
            F.col("o_custkey").alias("user_id"),
            F.when(F.col("o_orderkey") % 4 > 0, F.format_string("Take %d", "o_orderkey")).alias(
                "name"
            ),
            status.alias("status"),
            F.format_string(
                '{"instrument":"%s","capo":%d}', instrument, F.col("o_orderkey") % 5
            ).alias("config"),
            F.floor(F.col("o_totalprice") * 400).cast("bigint").alias("size_bytes"),
            F.sha2(
                F.format_string("%d/%d", F.col("o_custkey"), F.col("o_orderkey") % 7), 256
            ).alias("audio_sha256"),
            F.col("o_orderdate").alias("created_at"),
            F.when(~pending, F.col("o_orderdate")).alias("submitted_at"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + wait).alias("finished_at"),
            F.when(
                failed & (F.col("o_orderpriority") != "4-NOT SPECIFIED"),
                F.lower("o_orderpriority"),
            ).alias("error_code"),
            F.when(failed, F.concat(F.lit("stage stopped: "), F.col("o_orderpriority"))).alias(
                "error_message"
            ),
        )

    def stage_attempts(self) -> DataFrame:
        """One row per handled stage message; repeats of a (job, stage) are its attempts."""
        stages = F.array(*[F.lit(s) for s in (*STAGES, "render")])
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("job_id"),
            F.element_at(stages, F.col("l_linenumber")).alias("stage"),
            F.col("l_linenumber").cast("bigint").alias("stage_rank"),
            F.col("l_quantity").alias("duration_s"),
            F.col("l_shipdate").alias("finished_at"),
            (F.col("l_shipdate") - F.expr("make_dt_interval(0, 0, 0, l_quantity)")).alias(
                "started_at"
            ),
            F.when(F.col("l_returnflag") == "R", "failed")
            .when(F.col("l_returnflag") == "N", "skipped")
            .otherwise("succeeded")
            .alias("status"),
            (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("message_id"),
        )

    def messages(self) -> DataFrame:
        """Store webhooks, rate-limited calls and job requests: the service's event stream."""
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.table("events").select(
            "event_id", "ts", "user_id", "event_type", "value", k.alias("k")
        )

    def versions(self) -> DataFrame:
        c = self.table("conversations")
        mark = (F.col("conv_id") * 3 + F.col("turn") * 7) % 6
        return c.select(
            F.col("conv_id").alias("job_id"),
            F.col("turn").alias("version"),
            F.when(F.col("turn") == 0, "ready")
            .when(mark == 0, "failed")
            .when(mark == 1, "pending")
            .otherwise("ready")
            .alias("status"),
            F.when(F.col("turn") > 0, F.greatest(F.lit(0), F.col("turn") - 1 - mark % 2)).alias(
                "base_version"
            ),
        )

    # --- clips of notes ---

    def notes(self) -> DataFrame:
        """Transcribed notes: (clip_id, note_idx, onset, offset, pitch, velocity), times in ticks."""
        m = self.messages()
        onset = F.expr(
            f"(unix_micros(ts) - unix_micros(timestamp'{CORPUS_ORIGIN}')) div {MICROS_PER_TICK}"
        )
        return m.select(
            F.col("user_id").alias("clip_id"),
            F.col("event_id").alias("note_idx"),
            onset.alias("onset"),
            (onset + 500 + F.floor(F.col("value") * 25)).cast("bigint").alias("offset"),
            (F.lit(40) + F.col("k") % 49).alias("pitch"),
            (F.lit(1) + F.floor("value") % 127).cast("bigint").alias("velocity"),
        )

    def annotated(self) -> DataFrame:
        """A second reading of the same notes: shifted, some lost, some an octave off."""
        n = self.notes().where(F.col("note_idx") % 11 != 0)
        jitter = (F.col("note_idx") * 37 % 13 - 6) * 100
        stretch = (F.col("note_idx") * 53 % 9 - 4) * 120
        return n.select(
            "clip_id",
            "note_idx",
            F.greatest(F.lit(0), F.col("onset") + jitter).alias("onset"),
            (F.greatest(F.lit(0), F.col("onset") + jitter) + 490 + F.abs(stretch)).alias("offset"),
            F.when(F.col("note_idx") % 17 == 0, F.col("pitch") + 12)
            .otherwise(F.col("pitch"))
            .alias("pitch"),
            "velocity",
        )

    def beats(self) -> DataFrame:
        """Tracked beats of each clip, numbered from 0, past its last onset."""
        clips = self.notes().groupBy("clip_id").agg(F.max("onset").alias("last_onset"))
        step = F.lit(4000) + F.col("clip_id") % 7 * 350
        k = F.col("beat")
        spread = clips.select(
            "clip_id",
            step.alias("step"),
            F.explode(F.expr("sequence(0L, last_onset div (4000 + clip_id % 7 * 350))")).alias(
                "beat"
            ),
        )
        return spread.select(
            "clip_id",
            "beat",
            (F.lit(300) + k * F.col("step") + ((F.col("clip_id") * 31 + k * 17) % 11 - 5) * 20).alias(
                "tick"
            ),
            F.when((k + F.col("clip_id")) % 4 == 0, F.lit(90))
            .otherwise(F.lit(10) + (k * 7 + F.col("clip_id")) % 10)
            .alias("downbeat_weight"),
        )

    def frames(self) -> DataFrame:
        """Activation frames: one row per (clip, frame, pitch), at most 100 frames a clip."""
        e = self.table("embeddings").select(
            F.expr("vec_id div 100").alias("clip_id"),
            (F.col("vec_id") % 100).alias("frame"),
            F.posexplode("embedding").alias("bin", "raw"),
        )
        return e.select(
            "clip_id",
            "frame",
            (F.col("bin") + 21).cast("bigint").alias("pitch"),
            F.least(F.lit(1.0), F.abs(F.col("raw").cast("double")) * 3.0).alias("value"),
        )
