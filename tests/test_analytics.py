"""Product analytics on small records with numbers worked out by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tonelake.functions import constants as k
from tonelake.functions import text
from tonelake.operators import activity, billing, erasure, jobs, limits, quantiles, sliced, upserts
from tonelake.plans import library
from tonelake.sources.roles import Roles

NOW = datetime(2025, 3, 12, 12, 0)  # a Wednesday


def as_of():
    return F.lit("2025-03-12 12:00:00").cast("timestamp")


def ago(days=0.0):
    return NOW - timedelta(days=days)


@pytest.fixture(scope="module")
def accounts(spark):
    rows = [("a", ago(20), ago(0.5)), ("b", ago(3), ago(5)), ("c", ago(1), None)]
    return spark.createDataFrame(rows, "user_id string, joined timestamp, last_active timestamp")


@pytest.fixture(scope="module")
def job_rows(spark):
    def job(i, user, days, status="succeeded", code=None, sent=True):
        at = ago(days)
        return (i, user, status, code, at, at if sent else None)

    rows = [
        job(1, "a", 10),
        job(2, "a", 2, "failed", "bad_audio"),
        job(3, "b", 1),
        job(4, "b", 1, "pending_upload", sent=False),
        job(5, "c", 0.1),
        job(6, "c", 0.1),
    ]
    schema = """job_id int, user_id string, status string, error_code string, created_at timestamp,
        submitted_at timestamp"""
    return spark.createDataFrame(rows, schema)


def test_totals(job_rows):
    row = activity.totals(job_rows, as_of()).first().asDict()
    assert row == {
        "transcriptions": 5,
        "transcriptions_7d": 4,
        "failed": 1,
        "failed_7d": 1,
        "users_transcribed": 3,
    }


def test_active_accounts(accounts):
    row = activity.active_accounts(accounts, as_of()).first()
    assert tuple(row) == (3, 1, 2, 2)
    unknown = activity.active_accounts(accounts, as_of(), has_activity=False).first()
    assert tuple(unknown) == (3, None, None, None)


def test_daily_series_fills_empty_days(accounts, job_rows):
    days = activity.daily_series(job_rows, accounts, "2025-03-12 12:00:00", 30).collect()
    assert len(days) == 30
    assert sum(d.signups for d in days) == 3
    assert sum(d.transcriptions for d in days) == 5
    assert sum(d.failed for d in days) == 1


def test_error_counts(job_rows):
    assert [tuple(r) for r in activity.error_counts(job_rows, as_of()).collect()] == [("bad_audio", 1)]


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([("transcribe", 30.0), ("transcribe", 50.0)], "stage string, d double")
    row = quantiles.exact_percentiles(df, ["stage"], "d", {"m": 0.5, "p": 0.95}).first()
    assert (row.runs, row.m, round(row.p, 9)) == (2, 40.0, 49.0)


def test_percentiles_match_spark_on_skew(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"),
        ((F.col("id") * 7919) % 1009 / 7.0).alias("v"),
    )
    ours = quantiles.exact_percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.95, "c": 0.01})
    theirs = df.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.01))).alias("q"))
    for row in ours.join(theirs, "k").collect():
        assert [row.a, row.b, row.c] == pytest.approx(row.q)


def test_retention_keeps_empty_cohorts(spark):
    monday = datetime(2025, 2, 24)
    members = [(u, monday) for u in "abc"] + [("d", datetime(2025, 3, 11))]
    accounts = spark.createDataFrame(members, "user_id string, joined timestamp")
    made = [("a", monday), ("b", monday + timedelta(weeks=1)), ("b", monday + timedelta(weeks=1)), ("a", monday + timedelta(weeks=2))]
    rows = spark.createDataFrame(
        [(u, at, at) for u, at in made], "user_id string, created_at timestamp, submitted_at timestamp"
    )
    got = activity.retention(accounts, rows, "2025-03-12 12:00:00", 3).orderBy("week").collect()
    assert [r["size"] for r in got] == [3, 0, 1]
    assert [list(r["transcribed"]) for r in got] == [[1, 1, 1], [0, 0], [0]]


def test_a_user_filter_is_required(job_rows):
    with pytest.raises(ValueError):
        jobs.for_user(job_rows, None)


def test_cursor_round_trip_and_refusal(spark):
    df = spark.createDataFrame([(datetime(2024, 5, 1, 10, 0, 0, 123456), 77)], "at timestamp, id bigint")
    made = df.select(jobs.cursor(F.col("at"), F.col("id")).alias("c"), "at", "id")
    row = made.select(jobs.parse_cursor(F.col("c")).alias("p"), "at").first()
    assert (row.p.created_at, row.p.job_id) == (row.at, 77)
    bad = spark.createDataFrame([("!!",), ("bm90IGEgY3Vyc29y",)], "c string")
    assert all(r.p is None for r in bad.select(jobs.parse_cursor(F.col("c")).alias("p")).collect())


SUBSCRIPTION = """user_id string, environment string, store string, product_id string,
    entitlement string, period_type string, expires_at timestamp, grace_period_expires_at timestamp,
    billing_issue_at timestamp, unsubscribed_at timestamp, refunded_at timestamp"""


@pytest.mark.parametrize(
    ("change", "plan", "line"),
    [
        ({}, "pro", "Renews on 22 Mar 2025"),
        ({"unsubscribed_at": ago(1)}, "pro", "Ends on 22 Mar 2025"),
        ({"expires_at": ago(0.05)}, "free", "Pro ended on 12 Mar 2025"),
        (
            {"expires_at": ago(0.05), "grace_period_expires_at": ago(-6), "billing_issue_at": ago(0.05)},
            "pro",
            "Payment problem: update your payment method in the app store to keep Pro.",
        ),
        ({"refunded_at": ago(1)}, "free", "Refunded"),
        ({"period_type": "trial"}, "pro", "Free trial · Pro starts on 22 Mar 2025"),
        ({"environment": "sandbox"}, "free", None),
        ({"environment": "sandbox", "store": "promotional", "expires_at": None}, "pro", None),
    ],
)
def test_subscription_states(spark, change, plan, line):
    base = dict(
        user_id="u", environment="production", store="app_store", product_id="pro:monthly",
        entitlement="pro_access", period_type="normal", expires_at=ago(-10),
        grace_period_expires_at=None, billing_issue_at=None, unsubscribed_at=None, refunded_at=None,
    )
    subs = spark.createDataFrame([tuple({**base, **change}.values())], SUBSCRIPTION)
    nobody = spark.createDataFrame([], "user_id string")
    users = spark.createDataFrame([("u", "free", None)], "user_id string, plan string, plan_changed_by string")
    counted = billing.purchases_that_count(subs, nobody, "production", "pro_access")
    effective = billing.effective_subscription(counted, as_of())
    assert billing.effective_plan(users, effective).first().plan == plan
    lines = billing.subscription_flags(effective).select(billing.status_line().alias("l")).collect()
    assert [r.l for r in lines] == ([] if change.get("environment") == "sandbox" and plan == "free" else [line])


def counted_one_by_one(rows, start=None):
    """(admitted, counted) of each entry by a plain counter per (user, month)."""
    counts, out = dict(start or {}), {}
    for entry, user, at, refund, limit in sorted(rows, key=lambda r: (r[2], r[0])):
        key = (user, at.strftime("%Y-%m"))
        before = counts.get(key, 0)
        ok = not refund and (limit is None or before < limit)
        counts[key] = before + (-1 if refund else int(ok))
        out[entry] = (ok, counts[key])
    return out


LEDGER = "entry_id bigint, user_id string, at timestamp, is_refund boolean, month_limit int"


@pytest.mark.parametrize("seed,limits_of", [(2, (8, 3)), (4, (None, 6, 1, 0))])
def test_quota_equals_a_counter_while_limits_change(spark, seed, limits_of):
    """Refunds, limits that rise, fall and end, over two months and a user with most of the rows."""
    import random

    rng = random.Random(seed)
    rows = []
    for user, n in (("hot", 200), ("warm", 40), ("cold", 9)):
        limit = limits_of[0]
        for i in range(n):
            if rng.random() < 0.02:
                limit = rng.choice(limits_of)
            at = datetime(2025, 1, 1) + timedelta(hours=58 * 24 * i // n, minutes=rng.randint(0, 2) * 20)
            rows.append((len(rows), user, at, rng.random() < 0.35, limit))
    df = spark.createDataFrame(rows, LEDGER).repartition(5)
    start = [("hot", "2025-01", 7), ("warm", "2025-02", 2)]
    carried = spark.createDataFrame(start, "user_id string, month string, counted bigint")
    got = {r.entry_id: (r.admitted, r.counted) for r in limits.quota_admission(df, carried).collect()}
    assert got == counted_one_by_one(rows, {(u, m): n for u, m, n in start})


def test_refused_attempts_under_two_limits_do_not_merge(spark):
    """Counts that differ at the start may meet twice; no one pair of bounds describes such a row of steps."""
    at = datetime(2025, 3, 1)
    steps = [False, True, True, False]  # attempt, two refunds, attempt, all under a limit of 5
    last = {4: 4, 5: 4, 6: 5, 7: 5, 8: 6}
    rows = [(10 * n + i, f"u{n}", at + timedelta(hours=i), refund, 5) for n in last for i, refund in enumerate(steps)]
    carried = spark.createDataFrame([(f"u{n}", "2025-03", n) for n in last], "user_id string, month string, counted bigint")
    found = limits.quota_admission(spark.createDataFrame(rows, LEDGER), carried).where("entry_id % 10 = 3")
    assert {r.user_id: r.counted for r in found.collect()} == {f"u{n}": c for n, c in last.items()}


def test_first_admissions_of_a_hot_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("user_id"), "id"
    )
    admitted = limits.admit_first(df, ["user_id"], ["id"], 5).where("admitted AND user_id = 0")
    assert sorted(r.id for r in admitted.collect()) == [0, 3, 6, 9, 12]


def test_replace_clears_users_synced_to_nothing(spark):
    stored = spark.createDataFrame([("u", "p"), ("v", "p")], "user_id string, product string")
    synced = spark.createDataFrame([("u",)], "user_id string")
    left = upserts.replace_by_key(stored, synced, stored.limit(0), "user_id")
    assert [r.user_id for r in left.collect()] == ["v"]


def test_merge_keeps_values_a_write_leaves_null(spark):
    current = spark.createDataFrame([(1, "running", 2)], "id int, status string, attempts int")
    writes = spark.createDataFrame(
        [(1, "failed", None, 1), (2, "queued", 0, 1)], "id int, status string, attempts int, seq int"
    )
    got = {tuple(r) for r in upserts.merge(current, writes, ["id"], ["seq"]).collect()}
    assert got == {(1, "failed", 2), (2, "queued", 0)}


def test_plan_audit_chains_requests(spark):
    requests = spark.createDataFrame(
        [(1, "u", ago(3), "pro", "x"), (2, "u", ago(2.9), "free", None), (3, "u", ago(0), "unlimited", None)],
        "request_id int, user_id string, at timestamp, plan string, note string",
    )
    stored = spark.createDataFrame([("u", "unlimited")], "user_id string, plan string")
    rows = upserts.change_audit(requests, stored).orderBy("request_id").collect()
    assert [(r.from_plan, r.to_plan) for r in rows] == [("unlimited", "pro"), ("pro", "free"), ("free", "unlimited")]


def test_sliced_running_sum_and_previous(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id", (F.col("id") % 13).alias("v"))
    slice_ = F.expr("id div 37")
    summed = sliced.running_sum(df, ["k"], slice_, ["id"], "v", "total")
    both = sliced.previous(summed, ["k"], slice_, ["id"], {"v": "before"})
    expected, last = {0: 0, 1: 0}, {}
    for r in both.orderBy("id").collect():
        expected[r.k] += r.v
        assert (r.total, r.before) == (expected[r.k], last.get(r.k))
        last[r.k] = r.v


def test_text_functions(spark):
    row = spark.range(1).select(
        text.export_name(F.lit("Blues riff: take #2!"), F.lit("mid")).alias("name"),
        text.export_name(F.lit("///"), F.lit("mid")).alias("blank"),
        text.note_name(F.lit(64)).alias("note"),
        text.same_beats(F.lit("2/2"), F.lit("1")).alias("same"),
        text.user_prefix(F.lit("../x")).alias("escape"),
        text.valid_segment(F.lit("..")).alias("dots"),
        text.valid_segment(F.lit("a\n")).alias("line"),
        text.upload_type(F.lit("application/octet-stream"), F.lit("a.b.M4A")).alias("type"),
        text.is_audio(F.lit("normalize/a.flac")).alias("audio"),
        text.is_audio(F.lit("notation/a.flac")).alias("other"),
    ).first()
    assert row.name == "Blues riff take 2.mid" and row.blank == "Untitled score.mid"
    assert (row.note, row.same, row.escape, row.dots, row.line) == ("E4", True, None, False, False)
    assert (row.type, row.audio, row.other) == ("audio/mp4", True, False)


def test_null_keys_have_percentiles_too(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.runs, r.m) for r in quantiles.exact_percentiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {None: (2, 2.0), "a": (1, 5.0)}


def test_only_current_terms_pass_the_gate(spark):
    at = datetime(2026, 1, 1)
    requests = spark.createDataFrame(
        [(i, u, at, "audio/mp4", 10) for i, u in enumerate((1, 2, 3))],
        "request_id long, user_id long, at timestamp, content_type string, size_bytes long",
    )
    users = spark.createDataFrame(
        [(1, "free", "2026-01"), (2, "free", "2020-01"), (3, "free", None)],
        "user_id long, plan string, terms_version string",
    )
    users = users.withColumn("plan_changed_by", F.lit(None).cast("string"))
    nobody = spark.createDataFrame([], "user_id long, active boolean")
    got = {r.request_id: r.status for r in jobs.upload_gate(requests, users, nobody, 5, 3600).collect()}
    assert got == {0: 201, 1: 403, 2: 403}


def test_a_purchase_counts_at_the_gate(spark):
    """A free user with an active purchase may send what Pro may, one whose purchase ended may not."""
    at, size = datetime(2026, 1, 1), 100 << 20
    requests = spark.createDataFrame(
        [(i, i, at, "audio/mp4", size) for i in range(4)],
        "request_id long, user_id long, at timestamp, content_type string, size_bytes long",
    )
    users = spark.createDataFrame(
        [(0, "free", "2026-01", None), (1, "free", "2026-01", None), (2, "pro", "2026-01", "admin"), (3, "unlimited", "2026-01", "admin")],
        "user_id long, plan string, terms_version string, plan_changed_by string",
    )
    bought = spark.createDataFrame([(0, True), (1, False), (3, True)], "user_id long, active boolean")
    got = {r.request_id: r.status for r in jobs.upload_gate(requests, users, bought, 5, 3600).collect()}
    assert got == {0: 201, 1: 413, 2: 201, 3: 201}


def account_tables(spark):
    """User 0 owns a third of the jobs; event 2 names two users; a run and a version have no job."""
    jobs_of = [(j, 0 if j % 3 == 0 else j % 7 + 1) for j in range(60)]
    return {
        "users": spark.createDataFrame([(u,) for u in range(9)], "user_id bigint"),
        "jobs": spark.createDataFrame(jobs_of, "job_id bigint, user_id bigint"),
        "stage_runs": spark.createDataFrame([(j, s) for j, _ in jobs_of for s in "ab"] + [(999, "a")], "job_id bigint, stage string"),
        "score_versions": spark.createDataFrame([(j, 0) for j, _ in jobs_of] + [(None, 1)], "job_id bigint, version int"),
        "result_cache": spark.createDataFrame([(f"k{j}", j) for j, _ in jobs_of[:20]], "dedup_key string, job_id bigint"),
        "subscriptions": spark.createDataFrame([(0, "p"), (1, "p"), (8, "p")], "user_id bigint, product_id string"),
        "push_tokens": spark.createDataFrame([("t0", 0), ("t1", 1)], "token string, user_id bigint"),
        "admin_actions": spark.createDataFrame([(1, 0, "x"), (2, 1, "y"), (3, None, "z")], "id int, target_user_id bigint, detail string"),
        "billing_events": spark.createDataFrame([(1, [0]), (2, [3, 0]), (3, [1, 2]), (4, [])], "event_id bigint, user_ids array<bigint>"),
    }


def test_no_row_of_an_erased_user_is_left_in_nine_tables(spark):
    tables = account_tables(spark)
    kept = erasure.erase_accounts(tables, spark.createDataFrame([(0,), (0,), (77,)], "user_id bigint"))
    rows = {name: [tuple(r) for r in df.collect()] for name, df in kept.items()}
    assert all(kept[n].columns == tables[n].columns for n in tables)
    mine = {j for j in range(60) if j % 3 == 0}
    assert [u for (u,) in sorted(rows["users"])] == list(range(1, 9))
    assert {j for j, _ in rows["jobs"]} == set(range(60)) - mine
    assert {j for j, _ in rows["stage_runs"]} == set(range(60)) - mine | {999}
    assert {j for j, _ in rows["score_versions"]} == set(range(60)) - mine | {None}
    assert {j for _, j in rows["result_cache"]} == set(range(20)) - mine
    assert sorted(rows["subscriptions"]) == [(1, "p"), (8, "p")] and rows["push_tokens"] == [("t1", 1)]
    assert {i for i, *_ in rows["admin_actions"]} == {2, 3} and {e for e, _ in rows["billing_events"]} == {3, 4}
    with pytest.raises(ValueError, match="no rule"):
        erasure.erase_accounts({"waveforms": tables["users"]}, tables["users"])


def test_erasure_is_one_change(spark, tmp_path):
    """A change that fails half way is not seen; one that succeeds is seen in all tables; a second changes nothing."""
    store = erasure.TableSet(spark, str(tmp_path / "store"))
    assert store.newest() is None and store.read() == {}
    store.change(account_tables(spark))
    gone = spark.createDataFrame([(0,)], "user_id bigint")
    broken = {**erasure.erase_accounts(store.read(), gone)}
    broken["users"] = broken["users"].withColumn("user_id", F.expr("if(user_id > 5, raise_error('lost'), user_id)"))
    with pytest.raises(Exception, match="lost"):
        store.change({"jobs": broken["jobs"], "users": broken["users"]})
    assert store.newest() == 0 and store.read()["jobs"].count() == 60
    assert erasure.erase_from(store, gone) == 1
    counts = {n: df.count() for n, df in store.read().items()}
    assert counts["jobs"] == 40 and counts["users"] == 8 and len(counts) == 9
    erasure.erase_from(store, gone)
    assert {n: df.count() for n, df in store.read().items()} == counts


def test_annotated_clips_are_read_by_suite(spark, tmp_path):
    """Several files of two known suites and one unknown; other files and fields are left aside."""
    import json

    from tonelake.sources import records

    for suite, names in {"guitars": ("a", "b"), "pianos": ("c",), "drums": ("d",)}.items():
        (tmp_path / suite).mkdir()
        for i, name in enumerate(names):
            notes = [{"onset_s": 0.5, "offset_s": 1.0, "pitch": 60 + i, "string": 2, "fret": 1, "more": "x"}]
            body = {"track": name, "tempo_bpm": 120.0, "notes": notes, "beats_s": [0.0, 0.5]}
            (tmp_path / suite / f"{name}.truth.json").write_text(json.dumps(body, indent=1))
        (tmp_path / suite / "notes.json").write_text("[]")
    found = records.read_truth(spark, str(tmp_path), {"guitars": "guitar", "pianos": "piano"})
    rows = {(r.suite, r.track): (r.instrument, r.notes[0].pitch, r.beats_s, r.chords) for r in found.collect()}
    assert rows == {
        ("guitars", "a"): ("guitar", 60, [0.0, 0.5], None),
        ("guitars", "b"): ("guitar", 61, [0.0, 0.5], None),
        ("pianos", "c"): ("piano", 60, [0.0, 0.5], None),
    }


def test_domains_of_tokens_and_attempts(spark):
    tokens = ["ExponentPushToken[a_B-9]", "ExpoPushToken[x]", "ExpoPushToken[]", "PushToken[x]", "ExpoPushToken[x]\n", "ExpoPushToken[" + "x" * 300 + "]", None]
    df = spark.createDataFrame([(t, "ios") for t in tokens] + [("ExpoPushToken[y]", "web")], "token string, platform string")
    good, bad = jobs.quarantine(df, jobs.domain_rules("push_tokens"))
    assert {r.token for r in good.collect()} == set(tokens[:2])
    assert sorted((r.reasons, r.platform) for r in bad.collect()) == [(["platform"], "web")] + [(["token"], "ios")] * 5
    rows = [("tab", "cached", 1), ("tab", "lost", 0), ("mix", "failed", None)]
    _, bad = jobs.quarantine(spark.createDataFrame(rows, "stage string, status string, attempt int"), jobs.domain_rules("attempts"))
    assert sorted(r.reasons for r in bad.collect()) == [["stage", "attempt"], ["state", "attempt"]]


def test_stage_costs_beyond_64_bits(spark, tmp_path):
    """Two attempts three centuries apart in each of 2,000 jobs: more microseconds than 64 bits hold."""
    rows = [
        (job, 1, 1, at, 1, 5.0, "N", datetime(year, 1, 1))
        for job in range(2000)
        for at, year in ((2, 1700), (2, 2000), (3, 1700))
    ]
    schema = """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice int,
        l_quantity double, l_returnflag string, l_shipdate timestamp_ntz"""
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    between = (datetime(2000, 1, 1) - datetime(1700, 1, 1)) // timedelta(microseconds=1)
    found = {r.stage: r for r in library.stage_costs(Roles(spark, str(tmp_path))).collect()}
    second, third = (found[k.STAGES[i]] for i in (1, 2))
    assert (second.jobs, second.compute_us, second.overhead_us) == (2000, 2 * 2000 * 5_000_000, 2000 * (between - 5_000_000))
    assert third.gap_us == -2000 * (between + 5_000_000)
    assert 2000 * between > 2**63
