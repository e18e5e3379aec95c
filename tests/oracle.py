"""Compare registered queries with their SQL twins.

    python tests/oracle.py [--sf 0.01] [key ...]
"""

from __future__ import annotations

import argparse
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return ("f", repr(value))
    if isinstance(value, (list, dict)):
        return repr(value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, con, sf_dir, query, sql):
    """(ok, message, seconds)"""
    start = time.time()
    df = query(spark, sf_dir)
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if sql is None:
        return True, f"rows only: {len(got)}", seconds
    res = con.execute(sql)
    want_names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(got_names) != sorted(want_names):
        return False, f"columns {sorted(got_names)} != {sorted(want_names)}", seconds
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    if a == b:
        return True, f"rows {len(a)}", seconds
    only_a = [r for r in a if r not in b[:20000]][:3] if len(a) < 20000 else []
    only_b = [r for r in b if r not in a[:20000]][:3] if len(b) < 20000 else []
    first = next(((x, y) for x, y in zip(a, b) if x != y), None)
    return False, f"{len(a)} vs {len(b)} rows\n   spark only {only_a}\n   sql only   {only_b}\n   first {first}", seconds


def main() -> int:
    import __spark_entry__ as entry
    from webtables.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con = local_session("8"), duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in args.keys or queries:
        try:
            ok, message, seconds = compare(spark, con, sf_dir, queries[key], oracle.get(key))
        except Exception as exc:  # report and go on with the next key
            ok, message, seconds = False, "".join(traceback.format_exception_only(exc))[:400], 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {key:28} {seconds:6.2f}s  {message}", flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
