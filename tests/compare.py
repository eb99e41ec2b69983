"""Run a named query and its SQL and compare the rows, ignoring order.

`python tests/compare.py [sf] [name ...]` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return f"float {v + 0.0!r}"
        if isinstance(v, int):
            return f"int {v}"
        return repr(v)

    return [columns[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in rows)


def differences(spark, con, name: str, fn, sql: str, sf_dir: str) -> tuple[list[str], int, float, float]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    cur = con.execute(sql)
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    problems = []
    if got[0] != want[0]:
        problems.append(f"{name}: columns {got[0]} against {want[0]}")
    elif len(got[1]) != len(want[1]):
        problems.append(f"{name}: {len(got[1])} rows against {len(want[1])}")
    elif got[1] != want[1]:
        bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
        problems.append(f"{name}: {len(bad)} rows differ, first {bad[0][0]} against {bad[0][1]}")
    return problems, len(got[1]), t1 - t0, t2 - t1


def main(argv: list[str]) -> int:
    from weirflow.plans import ORACLES, QUERIES
    from weirflow.session import local_session

    sf = argv[0] if argv else "0.001"
    names = argv[1:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = duck(sf_dir)
    failed = 0
    for name in names:
        try:
            if name in ORACLES:
                problems, n, a, b = differences(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)
            else:
                t0 = time.time()
                n, problems, b = len(QUERIES[name](spark, sf_dir).collect()), [], 0.0
                a = time.time() - t0
        except Exception as e:  # report and go on with the next query
            problems, n, a, b = [f"{name}: {str(e)[:1500]}"], 0, 0.0, 0.0
        failed += bool(problems)
        kind = "FAIL" if problems else ("ok  " if name in ORACLES else "rows")
        print(f"{kind} {name:28s} {n:8d} rows  spark {a:6.2f}s  sql {b:6.2f}s", flush=True)
        for p in problems:
            print("    ", p, flush=True)
    print(f"{len(names) - failed}/{len(names)} agree")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
