"""Run registered queries against DuckDB: ``python -m gate.check [name-prefix ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from gate import ORACLE, QUERIES
from tapeweave.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def normal(v):
    if hasattr(v, "isoformat"):
        text = v.isoformat().replace("T", " ")
        return text[:10] if text.endswith(" 00:00:00") else text
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(normal(r[i]) for i in order)) for r in data)


def compare(spark, con, name: str, sf: str) -> str:
    start = time.time()
    df = QUERIES[name](spark, sf)
    mine = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if name not in ORACLE:
        return f"rows-only {len(mine)} rows {took:.1f}s"
    start = time.time()
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    oracle_took = time.time() - start
    if sorted(names) != sorted(df.columns):
        return f"FAIL columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows(df.columns, mine), rows(names, theirs)
    if a == b:
        return f"ok {len(a)} rows {took:.1f}s / {oracle_took:.1f}s" + ("  EMPTY" if not a else "")
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"FAIL {len(a)} vs {len(b)} rows, {len(only_a)} differ; {sorted(df.columns)}\n   spark {only_a[:3]}\n   duck  {only_b[:3]}"


def main(argv) -> int:
    sf = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        sf, argv = argv[0], argv[1:]
    names = [n for n in QUERIES if not argv or any(n.startswith(p) for p in argv)]
    spark, con, failed = local_session(8), connect(sf), 0
    for n in names:
        try:
            verdict = compare(spark, con, n, sf)
        except Exception as e:  # keep going: one report for all queries
            verdict = f"FAIL {type(e).__name__}: {str(e)[:600]}"
        failed += verdict.startswith("FAIL")
        print(f"{n}: {verdict}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
