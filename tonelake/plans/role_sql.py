"""The roles of `tonelake.sources.roles` as DuckDB common table expressions, for the oracles."""

from __future__ import annotations

JOBS_AS_OF = "TIMESTAMP '2001-08-01 12:00:00'"
EVENTS_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "accounts": (
        (),
        """SELECT c_custkey AS user_id, lower(c_name) || '@mail.test' AS email,
             CASE WHEN c_nationkey % 2 = 0 THEN 'google' ELSE 'email' END AS method,
             TIMESTAMP '1995-01-01' + to_days((c_custkey * 37 % 2404)::INT) AS joined,
             CASE WHEN c_acctbal > 0 THEN TIMESTAMP '2001-08-01 12:00:00'
               - to_days((c_custkey * 13 % 45)::INT) - INTERVAL 6 HOUR END AS last_active
           FROM customer""",
    ),
    "users": (
        (),
        """SELECT c_custkey AS user_id,
             CASE WHEN c_acctbal > 1000 THEN '2026-01' END AS terms_version,
             CASE c_mktsegment WHEN 'BUILDING' THEN 'pro' WHEN 'AUTOMOBILE' THEN 'unlimited'
               ELSE 'free' END AS plan,
             CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'admin-1' END
               AS plan_changed_by
           FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
    ),
    "jobs": (
        (),
        """SELECT o_orderkey AS job_id, o_custkey AS user_id,
             CASE WHEN o_orderkey % 4 > 0 THEN 'Take ' || o_orderkey END AS name,
             CASE WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'succeeded'
               WHEN o_orderkey % 5 = 0 THEN 'pending_upload' ELSE 'running' END AS status,
             '{"instrument":"' || CASE WHEN o_orderkey % 3 = 0 THEN 'piano' ELSE 'guitar' END
               || '","capo":' || (o_orderkey % 5) || '}' AS config,
             floor(o_totalprice * 400)::BIGINT AS size_bytes,
             sha256(o_custkey || '/' || (o_orderkey % 7)) AS audio_sha256,
             o_orderdate AS created_at,
             CASE WHEN NOT (o_orderstatus = 'P' AND o_orderkey % 5 = 0) THEN o_orderdate END
               AS submitted_at,
             CASE WHEN o_orderstatus <> 'P' THEN o_orderdate
               + to_microseconds(((o_orderkey % 97) * 1000000 + 250000)::BIGINT) END AS finished_at,
             CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '4-NOT SPECIFIED'
               THEN lower(o_orderpriority) END AS error_code,
             CASE WHEN o_orderstatus = 'F' THEN 'stage stopped: ' || o_orderpriority END
               AS error_message
           FROM orders""",
    ),
    "attempts": (
        (),
        """SELECT l_orderkey AS job_id,
             (['normalize','separate','transcribe','quantize','notation','tab','render'])
               [l_linenumber] AS stage,
             l_linenumber::BIGINT AS stage_rank, l_quantity AS duration_s,
             l_shipdate AS finished_at,
             l_shipdate - to_microseconds((l_quantity * 1000000)::BIGINT) AS started_at,
             CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'N' THEN 'skipped'
               ELSE 'succeeded' END AS status,
             l_partkey * 100000 + l_suppkey AS message_id
           FROM lineitem""",
    ),
    "messages": (
        (),
        """SELECT event_id, ts, user_id, event_type, value,
             CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    ),
    "versions": (
        (),
        """SELECT conv_id AS job_id, turn AS version,
             CASE WHEN turn = 0 THEN 'ready' WHEN (conv_id * 3 + turn * 7) % 6 = 0 THEN 'failed'
               WHEN (conv_id * 3 + turn * 7) % 6 = 1 THEN 'pending' ELSE 'ready' END AS status,
             CASE WHEN turn > 0 THEN greatest(0, turn - 1 - ((conv_id * 3 + turn * 7) % 6) % 2) END
               AS base_version
           FROM conversations""",
    ),
    "notes": (
        ("messages",),
        """SELECT user_id AS clip_id, event_id AS note_idx, onset,
             (onset + 500 + floor(value * 25))::BIGINT AS "offset", 40 + k % 49 AS pitch,
             (1 + floor(value)::BIGINT % 127)::BIGINT AS velocity
           FROM (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 20000000 AS onset
                 FROM messages)""",
    ),
    "annotated": (
        ("notes",),
        """SELECT clip_id, note_idx, o AS onset, o + 490 + abs((note_idx * 53 % 9 - 4) * 120)
               AS "offset",
             CASE WHEN note_idx % 17 = 0 THEN pitch + 12 ELSE pitch END AS pitch, velocity
           FROM (SELECT *, greatest(0, onset + (note_idx * 37 % 13 - 6) * 100) AS o FROM notes
                 WHERE note_idx % 11 <> 0)""",
    ),
    "beats": (
        ("notes",),
        """SELECT clip_id, beat,
             300 + beat * (4000 + clip_id % 7 * 350) + ((clip_id * 31 + beat * 17) % 11 - 5) * 20
               AS tick,
             CASE WHEN (beat + clip_id) % 4 = 0 THEN 90 ELSE 10 + (beat * 7 + clip_id) % 10 END
               AS downbeat_weight
           FROM (SELECT clip_id, unnest(range(0, last_onset // (4000 + clip_id % 7 * 350) + 1))
                   AS beat
                 FROM (SELECT clip_id, max(onset) AS last_onset FROM notes GROUP BY 1))""",
    ),
    "frames": (
        (),
        """SELECT vec_id // 100 AS clip_id, vec_id % 100 AS frame,
             (20 + i)::BIGINT AS pitch,
             least(1.0::DOUBLE, abs(embedding[i]::DOUBLE) * 3.0::DOUBLE) AS value
           FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
    ),
    # beat intervals with open ends: the first also covers earlier times, the last later ones
    "spans": (
        ("beats",),
        """SELECT clip_id, beat, tick AS t0, lead(tick) OVER w AS t1,
             row_number() OVER w = 1 AS is_first,
             row_number() OVER w = count(*) OVER (PARTITION BY clip_id) - 1 AS is_last
           FROM beats WINDOW w AS (PARTITION BY clip_id ORDER BY beat)
           QUALIFY lead(tick) OVER w IS NOT NULL""",
    ),
}


def with_roles(
    roles: str, body: str, recursive: bool = False, instead: dict[str, tuple[str, str]] | None = None
) -> str:
    """`body` with the named roles (and the roles they read) in front of it.

    `instead` has roles, as (roles they read, SQL), that take the place of those of the same name.
    """
    own = {name: (tuple(needs.split()), sql) for name, (needs, sql) in (instead or {}).items()}
    known = {**_CTES, **own}
    ordered: list[str] = []

    def visit(role: str) -> None:
        for needed in known[role][0]:
            visit(needed)
        if role not in ordered:
            ordered.append(role)

    for role in roles.split():
        visit(role)
    ctes = [f"{role} AS ({known[role][1]})" for role in ordered]
    body = body.strip()
    keyword = "WITH RECURSIVE" if recursive else "WITH"
    joiner = ",\n" if body.upper().startswith("WITH ") else "\n"
    if joiner == ",\n":
        body = body[5:]
    return f"{keyword} " + ",\n".join(ctes) + joiner + body


def add_role(name: str, needs: str, sql: str) -> None:
    """A further shared expression, built on the roles it names."""
    _CTES[name] = (tuple(needs.split()), sql)
