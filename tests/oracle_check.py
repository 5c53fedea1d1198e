"""Run registered queries and their DuckDB statements on the same tables and compare them.

    python tests/oracle_check.py [--sf 0.001] [name prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value):
    if value is None:
        return "\0"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def rowset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, queries, oracles):
    started = time.time()
    df = queries[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - started
    if name not in oracles:
        return ("rows-only", len(rows), spent, "")
    cur = con.execute(oracles[name])
    cols = [d[0] for d in cur.description]
    expected = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return ("SCHEMA", len(rows), spent, f"{sorted(df.columns)} vs {sorted(cols)}")
    kinds = {d[0]: str(d[1]) for d in cur.description}
    odd = [c for c, k in kinds.items() if k in ("HUGEINT",) or k.startswith("DECIMAL")]
    a, b = rowset(df.columns, rows), rowset(cols, expected)
    if a == b and not odd:
        return ("ok", len(rows), spent, "")
    if odd:
        return ("TYPE", len(rows), spent, str(odd))
    left = [r for r in a if r not in set(b)][:3]
    right = [r for r in b if r not in set(a)][:3]
    return ("DIFF", len(rows), spent, f"{len(a)} vs {len(b)}\n   spark {left}\n   duck  {right}")


def main() -> int:
    from tonelake.session import build_session

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = "0.001"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i : i + 2]
    sf_dir = sf if os.path.isdir(sf) else f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = tables(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            state, n, spent, detail = compare(spark, con, sf_dir, name, queries, oracles)
        except Exception as error:  # noqa: BLE001
            state, n, spent, detail = "ERROR", 0, 0.0, str(error)[:900]
        bad += state not in ("ok", "rows-only")
        print(f"{state:10s} {n:7d} {spent:6.2f}s {name} {detail}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
