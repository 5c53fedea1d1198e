"""What the physical plans must look like, and what importing must not need."""

import os
import subprocess
import sys

from conftest import SF_DIR
from pyspark.sql import functions as F

import __spark_entry__ as entry


def plan_of(spark, df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_catalog_loads_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, cwd=os.path.dirname(entry.__file__))
    assert done.returncode == 0, done.stderr.decode()[-500:]


def test_time_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, entry.queries()["a3_jobs_per_day"](spark, SF_DIR))
    assert "GreaterThanOrEqual(o_orderdate" in plan
    assert "o_totalprice" not in plan


def test_first_n_per_key_is_cut_before_the_shuffle(spark):
    for name in ("w5_rate_limit", "t4_devices_capped", "t9_balanced_sample"):
        plan = plan_of(spark, entry.queries()[name](spark, SF_DIR))
        assert plan.count("WindowGroupLimit") == 2, name


def test_no_query_needs_a_cartesian_product(spark):
    for name in ("j3_daily_series", "j2_user_directory", "a9_operations_snapshot", "j14_segment_overlaps", "a21_onset_envelope"):
        plan = plan_of(spark, entry.queries()[name](spark, SF_DIR))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_roles_keep_every_row(spark, roles):
    assert roles.notes().count() == roles.table("events").count()
    assert roles.stage_attempts().count() == roles.table("lineitem").count()
    beats = roles.beats().groupBy("clip_id").agg(F.count("*").alias("n"), F.max("beat").alias("last"))
    assert all(r.n == r.last + 1 for r in beats.collect())


def test_every_frame_of_a_clip_has_a_span(roles):
    from tonelake.plans import harmony

    frames = roles.frames().select("clip_id", "frame").distinct()
    assert frames.join(harmony.members(roles), ["clip_id", "frame"], "left_anti").count() == 0
