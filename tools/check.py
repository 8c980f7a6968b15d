"""Run named queries against their DuckDB twins: rows, columns, and order-free values must match.

usage: python tools/check.py [--sf 0.01] [--shuffle 8] [NAME ...]   (NAME may end in * )
"""

from __future__ import annotations

import fnmatch
import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb  # noqa: E402

from kledger.plans import ORACLES, QUERIES  # noqa: E402
from kledger.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
    return str(v)


def rows_of(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(t[i]) for i in order) for t in tuples)


def compare(spark, con, name, sf_dir, show=3):
    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if name not in ORACLES:
        return ("ROWS" if got else "EMPTY"), len(got), None, t1 - t0, 0.0, ""
    cur = con.execute(ORACLES[name])
    want_names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    note = ""
    if sorted(df.columns) != sorted(want_names):
        return "SCHEMA", len(got), len(want), t1 - t0, t2 - t1, f"{sorted(df.columns)} vs {sorted(want_names)}"
    a, b = rows_of(df.columns, got), rows_of(want_names, want)
    status = "OK" if a == b else "DIFF"
    if a == b and not a:
        status = "EMPTY"
    if a != b:
        sa, sb = set(a), set(b)
        note = f"cols={sorted(df.columns)}\n   spark-only={[x for x in a if x not in sb][:show]}\n   duck-only ={[x for x in b if x not in sa][:show]}"
    bad = [d for d in (con.execute("DESCRIBE " + ORACLES[name]).fetchall() if a == b else []) if "HUGEINT" in d[1] or "[]" in d[1] or "STRUCT" in d[1] or "DECIMAL" in d[1]]
    if bad:
        note += f" type-warn {[(d[0], d[1]) for d in bad]}"
    return status, len(got), len(want), t1 - t0, t2 - t1, note


def main():
    args = sys.argv[1:]
    sf, shuffle = "0.01", 8
    while args and args[0].startswith("--"):
        if args[0] == "--sf":
            sf = args[1]
        if args[0] == "--shuffle":
            shuffle = int(args[1])
        args = args[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", shuffle)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    names = [n for n in QUERIES if not args or any(fnmatch.fnmatch(n, a) for a in args)]
    tally: dict[str, int] = {}
    for n in names:
        try:
            st, g, w, ts, td, note = compare(spark, con, n, sf_dir)
        except Exception as exc:  # report and go on
            st, g, w, ts, td, note = "ERROR", 0, 0, 0.0, 0.0, str(exc)[:700]
        tally[st] = tally.get(st, 0) + 1
        print(f"{st:7} {n:12} rows={g}/{w} spark={ts:.2f}s duck={td:.2f}s {note}", flush=True)
    print(tally)


if __name__ == "__main__":
    main()
