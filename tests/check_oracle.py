"""Compare registered queries with their SQL in DuckDB: python tests/check_oracle.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, int):
        return f"{v:.6f}" if abs(v) < 2**52 else str(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([canon(r[i]) for i in order] for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, build, sql):
    started = time.time()
    df = build(spark, sf_dir)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    if sql is None:
        return f"rows-only {len(got)}", spent, bool(got)
    started = time.time()
    result = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in result.description], result.fetchall())
    spent_sql = time.time() - started
    if got_columns != want_columns:
        return f"COLUMNS {got_columns} != {want_columns}", spent, False
    if got != want:
        have, need = {tuple(x) for x in got}, {tuple(x) for x in want}
        a, b = sorted(have - need)[:3], sorted(need - have)[:3]
        return f"ROWS {len(got)} vs {len(want)}\n   spark {a}\n   duck  {b}", spent, False
    return f"ok {len(got)} (sql {spent_sql:.1f}s)", spent, len(got) > 0


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from colophon.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark, con, bad = local_session("check"), connect(sf_dir), []
    oracles = oracle_sql()
    for name, build in queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            text, spent, fine = compare(spark, con, sf_dir, build, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            text, spent, fine = f"FAILED {type(e).__name__}: {str(e)[:1500]}", 0.0, False
        print(f"{'' if fine else '!! '}{name}: {text} [{spent:.1f}s]", flush=True)
        if not fine:
            bad.append(name)
    print("bad:", bad)
